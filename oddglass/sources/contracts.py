"""Versioned column contracts of all tables, and what a written table's schema breaks of them.

A contract is a nested schema with a version.  A later version may add columns and widen types, and
nothing else, so tables of every earlier version can be read as the newest one.  ``compare`` walks
two schemas together, into structs, arrays and maps, and names each difference by its path.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types that hold every value of the ones before them.
WIDER = (("tinyint", "smallint", "int", "bigint"), ("float", "double"), ("date", "timestamp_ntz"), ("tinyint", "smallint", "int", "double"))


@dataclass(frozen=True)
class Contract:
    role: str
    version: int
    ddl: str

    @property
    def schema(self) -> T.StructType:
        """Read from its text by the running session."""
        return T.StructType.fromDDL(self.ddl)


contract = Contract


def holds(wide: T.DataType, narrow: T.DataType) -> bool:
    """Can the wide type hold every value of the narrow one?"""
    a, b = wide.simpleString(), narrow.simpleString()
    if isinstance(wide, T.DecimalType) and isinstance(narrow, T.DecimalType):
        return wide.scale >= narrow.scale and wide.precision - wide.scale >= narrow.precision - narrow.scale
    return a == b or any(a in chain and b in chain and chain.index(a) > chain.index(b) for chain in WIDER)


def compare(have: T.DataType, want: T.DataType, path: str = "") -> list[tuple[str, str]]:
    """(path, kind) of each difference: missing, added, widened, narrowed, changed or nullable."""
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        mine, theirs = {f.name: f for f in have.fields}, {f.name: f for f in want.fields}
        out = []
        for name, f in theirs.items():
            at = f"{path}.{name}" if path else name
            if name not in mine:
                out.append((at, "missing"))
                continue
            out += compare(mine[name].dataType, f.dataType, at)
            if mine[name].nullable and not f.nullable:
                out.append((at, "nullable"))
        return out + [(f"{path}.{n}" if path else n, "added") for n in mine if n not in theirs]
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return compare(have.elementType, want.elementType, f"{path}[]")
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        return compare(have.keyType, want.keyType, f"{path}.key") + compare(have.valueType, want.valueType, f"{path}.value")
    if have == want or have.simpleString() == want.simpleString():
        return []
    return [(path, "widened" if holds(have, want) else "narrowed" if holds(want, have) else "changed")]


#: Differences that a reader of the contract cannot do without.
BREAKS = ("missing", "narrowed", "changed", "nullable")


def evolves(old: Contract, new: Contract) -> list[tuple[str, str]]:
    """What a new version may not do to an old one: take columns away, narrow or change them."""
    return [(p, k) for p, k in compare(new.schema, old.schema) if k in ("missing", "narrowed", "changed")]


class Contracts:
    """All versions of all roles; each version is checked against the one before it when first used."""

    def __init__(self, *contracts: Contract):
        self.given = sorted(contracts, key=lambda x: (x.role, x.version))

    @cached_property
    def of(self) -> dict[str, dict[int, Contract]]:
        out: dict[str, dict[int, Contract]] = {}
        for k in self.given:
            versions = out.setdefault(k.role, {})
            if versions and (bad := evolves(versions[max(versions)], k)):
                raise ValueError(f"{k.role} version {k.version} breaks the one before: {bad}")
            versions[k.version] = k
        return out

    def newest(self, role: str) -> Contract:
        return self.of[role][max(self.of[role])]

    def violations(self, spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
        """(role, version, path, kind, breaking) of each table against every version of its role."""
        found = [(role, v, p, k, k in BREAKS) for role, df in sorted(tables.items()) for v, c in self.of[role].items() for p, k in compare(df.schema, c.schema)]
        return spark.createDataFrame(found, "role string, version int, path string, kind string, breaking boolean")

    def read(self, spark: SparkSession, role: str, path: str) -> DataFrame:
        """A written table of any version as the newest one: added columns null, widened ones cast.

        A column that the newest contract holds in a narrower type stops the read, since values could be lost.
        """
        df, want = spark.read.parquet(path), self.newest(role).schema
        bad = [(p, k) for p, k in compare(df.schema, want) if k in ("widened", "changed")]
        if bad:
            raise TypeError(f"{role}: {bad}")
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])


# Every role's contract. Version 2 of the live events adds a column, that of the game log widens two.
CONTRACTS = Contracts(
    contract("seasons", 1, "subject_id bigint, year int, name string, team int, n bigint, hr bigint, price_c bigint, war double"),
    contract("games", 1, "subject_id bigint, game_date date, ab int, hits int, bb bigint, price_c bigint"),
    contract("games", 2, "subject_id bigint, game_date date, ab bigint, hits bigint, bb bigint, price_c bigint"),
    contract("pitches", 1, "subject_id bigint, game_pk bigint, seq int, part_id bigint, game_date date, season int, hand string, pitch_type string, description string, zone int, plate_x double, plate_z double, speed double, price_c bigint, disc_c bigint, tax_c bigint, qty int"),
    contract("stats", 1, "subject_id bigint, year int, pa bigint, swings bigint, woba double, est_woba double, ba double, est_ba double, sprint_speed double, exit_velocity double, brl_percent double, hard_hit_percent double, k_percent double, whiff_percent double, chase_percent double, name string, team int"),
    contract("live", 1, "event_id bigint, user_id bigint, event_type string, value double, ts timestamp_ntz"),
    contract("live", 2, "event_id bigint, user_id bigint, event_type string, value double, ts timestamp_ntz, props string"),
    contract("points", 1, "vec_id bigint, label int, x double, y double, z double"),
    contract("orders", 1, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
    contract("customer", 1, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    contract("supplier", 1, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    contract("documents", 1, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
    contract("embeddings", 1, "vec_id bigint, embedding array<float>, label int"),
    contract("conversations", 1, "conv_id bigint, turn bigint, role string, text string"),
    contract("labels", 1, "doc_id bigint, quality int, toxic int"),
)
