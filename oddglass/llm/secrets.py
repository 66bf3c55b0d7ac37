"""Secret scans: fixed patterns plus a linear-chain conditional random field.

Patterns give the base spans. The field tags the words of a text as secret begin, inside or
outside, from the word's shape, the neighbouring words and features of the whole file; Viterbi
finds the best tags. It is fitted in numpy by its likelihood on (a) words of a bounded sample of
documents, tagged by the base spans, and (b) generated lines in which known random secrets stand
in many forms beside look-alikes (numbers, dates, addresses, links).

A word of letters in usual case, under LONG of them, without a sign inside, and neither after a
sign nor within two words of a name such as "token", has the same scores wherever it stands. Where
the fitted weights make every path better that is outside at such a word, the text falls into
separate runs of the other words, and Viterbi on those alone has the very same result. With weights
that do not, Viterbi runs over every word. The fit is not altered for this.

Null and empty texts have no spans. Base spans always stay; a span of the field is left out only
where base spans hold all of it, and masking covers the union. Texts are scanned whole inside Spark's own partitions, without a shuffle;
rows are kept one for one, repeated rows and null ids included.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_texts, narrow, rows, sample_by_hash, texts

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so short runs can be skipped at once
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")

#: Letters of a long word; signs that ordinary words do not hold between letters.
LONG = 16
TRIGGER = re.compile(r"[0-9=:]|[a-z][A-Z]|(?<![A-Za-z])[A-Za-z]{%d}|[A-Za-z][!#$%%^&*~@+_|\\<>?;]+[A-Za-z]" % LONG)
SPACE = " \t\n\x0b\x0c\r"
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = {"password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "credentials", "access_key", "client_secret", "private_key"}
#: Every name holds one of these.
NAME_PARTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")
B, I, O = 0, 1, 2
SIGNS = ("=", ":")
STRIP = "\"'`,;.!?()[]{}<>#*%&$|"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in order."""
    found = []
    raw = text.encode("utf-8", "replace").lower()
    if any(k in raw for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def file_features(text: str) -> tuple[str, ...]:
    """Features shared by all words of a text."""
    raw = text.encode("utf-8", "replace").lower()
    return ("file:names",) if any(k in raw for k in KEYWORDS) else ()


def shape(core: str) -> str:
    if not core:
        return "none"
    if re.fullmatch(r"[0-9]+", core):
        return "number"
    if re.fullmatch(r"[0-9][0-9.,:/x+-]*", core):
        return "figures"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core) and re.search("[0-9]", core):
        return "hex"
    if "@" in core:
        return "mail"
    if "://" in core or core.startswith("www."):
        return "link"
    if re.fullmatch(r"[A-Za-z0-9+/_=.-]+", core) and re.search("[0-9]", core) and re.search("[A-Za-z]", core):
        if re.search("[a-z]", core) and re.search("[A-Z]", core):
            return "mixed"
        return "letters+digits"
    if core.lower() in NAMES:
        return "name"
    if re.search(r"[A-Za-z0-9][!#$%^&*~+_|\\<>?;=:/-]+[A-Za-z0-9]", core) and re.search("[0-9]", core):
        return "signs+digits"
    if re.search(r"[A-Za-z][!#$%^&*~+_|\\<>?;]+[A-Za-z]", core):
        return "signs"
    if re.search("[a-z][A-Z]", core):
        return "cased" if len(re.findall("[a-z][A-Z]", core)) < 3 else "often cased"
    return "long" if re.search(r"(?<![A-Za-z])[A-Za-z]{%d}" % LONG, core) else "word"


def describe(word: str) -> tuple[str, ...]:
    """Features of one word by itself."""
    core = word.strip(STRIP).rstrip("=:")
    value = core
    for sign in "=:":
        if sign in core and "://" not in core:
            name, _, value = core.partition(sign)
            value = value.strip(STRIP)
            if name.strip(STRIP).lower() in NAMES:
                return ("pair", f"pair:{shape(value)}", f"pair:{shape(value)}:{min(len(value) // 6, 6)}")
            break
    kind = shape(core)
    own = [kind, f"{kind}:{min(len(core) // 6, 6)}"]
    if word in SIGNS:
        own.append("sign")
    elif word[-1] in "=:":
        own.append("ends in sign")
    if kind in ("mixed", "letters+digits", "hex") and len(core) >= 12:
        own.append("dense" if len(set(core)) >= min(len(core), 16) * 0.55 else "sparse")
    return tuple(own)


PLAIN = ("word",)
#: Kinds of words that are plain where nothing before them announces a value.
PLAIN_KINDS = ("word", "name", "none", "mail", "link")


def context(described: list[tuple[str, ...]], i: int) -> str:
    """What stands before word ``i`` and may announce a value."""
    last = described[i - 1] if i else PLAIN
    older = described[i - 2] if i > 1 else PLAIN
    if last[-1] == "sign" or "ends in sign" in last:
        return f"after {older[0] if last[-1] == 'sign' else last[0]} and sign"
    if last[0] == "name":
        return "after name"
    return "one after name" if older[0] == "name" else ""


def word_features(described: list[tuple[str, ...]], i: int, whole: tuple[str, ...]) -> list[str]:
    """Features of word ``i``; ``described`` has the neighbours too. Plain words have no context."""
    own = described[i]
    before_it = context(described, i)
    if not before_it and own[0] in PLAIN_KINDS and own[-1] not in ("sign", "ends in sign"):
        return ["0 plain", *(f"plain {x}" for x in whole)]
    out = [f"0 {x}" for x in own] + [f"{own[0]} {x}" for x in whole]
    for k in (-2, -1, 1):
        near = described[i + k] if 0 <= i + k < len(described) else PLAIN
        out.append(f"{k} {near[0]}")
        out += [f"{k} {x}" for x in near if x in ("sign", "ends in sign")]
    if before_it:
        out += [f"{before_it}: {own[0]}", f"{before_it}: {own[min(1, len(own) - 1)]}"]
    return out


def hits(text: str) -> list[tuple[int, int]]:
    """Words that are not plain: by themselves, or by what stands before them."""
    out, at = set(), 0
    while m := TRIGGER.search(text, at):
        a = m.start()
        while a > 0 and text[a - 1] not in SPACE:
            a -= 1
        at = NOT_SPACE.match(text, a).end()
        out.add((a, at))
        if (word := text[a:at])[-1] in "=:" and (near := NOT_SPACE.search(text, at)):
            if word in SIGNS or "ends in sign" in describe(word):
                out.add(near.span())
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(LOWER)
    for name in NAME_PARTS:
        at = low.find(name)
        while at >= 0:
            a = at
            while a > 0 and text[a - 1] not in SPACE:
                a -= 1
            end = stop = NOT_SPACE.match(text, a).end()
            if describe(text[a:end])[0] == "name":
                for _ in range(2):
                    if near := NOT_SPACE.search(text, end):
                        out.add(near.span())
                        end = near.end()
            at = low.find(name, stop)
    return sorted(out)


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Hits with nothing but space between them, together."""
    out: list[list[tuple[int, int]]] = []
    for a, b in hits(text):
        if out and not text[out[-1][-1][1]:a].strip(SPACE):
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def before(text: str, at: int, wanted: int) -> list[str]:
    """Up to ``wanted`` words before a place, in order."""
    out = []
    while len(out) < wanted:
        while at > 0 and text[at - 1] in SPACE:
            at -= 1
        end = at
        while at > 0 and text[at - 1] not in SPACE:
            at -= 1
        if at == end:
            break
        out.append(text[at:end])
    return out[::-1]


def described_run(text: str, places: list[tuple[int, int]]) -> tuple[list[tuple[str, ...]], int]:
    """The words of a run and of its neighbourhood, and how many of them stand before the run."""
    left = before(text, places[0][0], 2)
    right = NOT_SPACE.search(text, places[-1][1])
    words = [*left, *(text[a:b] for a, b in places), *([right.group()] if right else [])]
    return list(map(describe, words)), len(left)


class Field:
    """Weights of the fitted field."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        plain = [self.emission(word_features([PLAIN], 0, whole)) for whole in ((), ("file:names",))]
        self.lead = float(min(e[O] - max(e[B], e[I]) for e in plain))
        # turning a plain word's tag to outside gains, whatever the tags beside it
        lost = max(float((moves[:, t, None] + moves[t][None] - moves[:, O, None] - moves[O][None]).max()) for t in (B, I))
        self.separable = self.lead > lost + 1e-9

    def emission(self, features: list[str]) -> np.ndarray:
        own = [self.index[f] for f in features if f in self.index]
        return self.weights[own].sum(0) if own else np.zeros(3)

    def tags(self, described: list[tuple[str, ...]], first: int, count: int, whole: tuple[str, ...]) -> list[int]:
        """Viterbi over ``count`` words; before and after them stands the tag outside."""
        best = None
        back = []
        for i in range(first, first + count):
            e = self.emission(word_features(described, i, whole))
            if best is None:
                best = self.moves[O] + e
            else:
                reach = best[:, None] + self.moves
                back.append(reach.argmax(0))
                best = reach.max(0) + e
        at = int((best + self.moves[:, O]).argmax())
        out = [at]
        for step in reversed(back):
            at = int(step[at])
            out.append(at)
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        whole = None
        for places in runs(text) if self.separable else [[m.span() for m in NOT_SPACE.finditer(text)] or None]:
            if places is None:
                continue
            whole = file_features(text) if whole is None else whole
            described, first = described_run(text, places)
            start = end = -1
            for (a, b), tag in zip(places, self.tags(described, first, len(places), whole)):
                word = text[a:b]
                a, b = a + len(word) - len(word.lstrip(STRIP)), b - len(word) + len(word.rstrip(STRIP))
                if start >= 0 and tag != I:
                    found.append((start, end, "crf"))
                    start = -1
                if tag != O and b > a:
                    start = a if start < 0 else start
                    end = b
            if start >= 0:
                found.append((start, end, "crf"))
        return found


def all_spans(text: str, field: Field | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and base spans with those of the field that say more than they do."""
    base = base_spans(text)
    more = []
    if field is not None:
        k, reach = 0, -1  # how far base spans that start up to a place reach without a gap
        for a, b, kind in field.spans(text):
            while k < len(base) and base[k][0] <= max(a, reach):
                reach, k = max(reach, base[k][1]), k + 1
            if reach < b:
                more.append((a, b, kind))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def tagged(text: str) -> list[tuple[list[list[str]], list[int]]]:
    """Features and tags of a document's runs, tagged by its base spans."""
    spans, whole = base_spans(text), file_features(text)
    out = [([word_features([PLAIN], 0, whole)], [O])]
    for places in runs(text):
        described, first = described_run(text, places)
        tags, last = [], None
        for a, b in places:
            over = next((s for s in spans if s[0] < b and a < s[1]), None)
            # the name and the sign of an assignment belong to no secret: only its value does
            if over is not None and (over[2] != "assign" or re.search(r"[A-Za-z0-9+/_.-]{6,}", text[max(a, over[0]):min(b, over[1])]) and b >= over[1]):
                tags.append(I if over is last else B)
                last = over
            else:
                tags.append(O)
                last = None
        out.append(([word_features(described, first + i, whole) for i in range(len(places))], tags))
    return out


def generated(count: int, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Lines with a known secret, or a known look-alike, among plain words."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    dense = letters + letters.upper() + "0123456789"
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    out = []
    for _ in range(count):
        name = r.choice(sorted(NAMES))
        value = r.choice((lambda: "a1" + pick("0123456789abcdef", r.randrange(14, 62)), lambda: "A1b" + pick(dense, r.randrange(14, 50)), lambda: "x7" + pick(letters + "0123456789", r.randrange(14, 40))))()
        form = r.random()  # also values without a digit, and with signs
        if form < 0.12:
            value = pick(letters, r.randrange(12, 30))
        elif form < 0.24:
            value = "".join(pick(letters, 1).upper() + pick(letters, 1) for _ in range(r.randrange(5, 16)))
        elif form < 0.3:
            value = "".join(r.choice((str.upper, str.lower))(c) for c in "aB" * 3 + pick(letters, r.randrange(6, 24)))
        elif form < 0.42:
            value = "Ab" + pick(dense, r.randrange(3, 8)) + r.choice("!#$%^&*~") + pick(dense, r.randrange(4, 12)) + "z7"
        elif form < 0.5:
            value = "pQ" + pick(letters, r.randrange(2, 6)) + r.choice("!#$%^&*~") + pick(letters, r.randrange(5, 12))
        bare = form < 0.12  # small letters alone need a sign before them
        fill = [pick(letters, r.randrange(2, 9)) for _ in range(6)]
        number = pick("123456789", r.randrange(1, 17))
        date = f"20{r.randrange(10, 30)}-0{r.randrange(1, 10)}-1{r.randrange(10)}"
        mail = f"{pick(letters, 6)}.{r.randrange(99)}@{pick(letters, 5)}{r.randrange(9)}.example.com"
        link = f"https://{pick(letters, 8)}.example.org/{pick(letters, 5)}/{r.randrange(9999)}"
        code = pick(letters, r.randrange(1, 8)) + pick("0123456789", r.randrange(1, 4))
        secret = r.choice(([name, "=", f'"{value}"'], [name + ":", value], [f"{name}={value}"], *([] if bare else [[name, value], [name, "is", value]]), [f'"{name}":', f'"{value}",']))
        other = r.choice(([number], [date], [mail], [link], [code], ["page", number], ["x", "=", number], ["note:", fill[0]], ["the", code + "."], ["tel:", number], [f"{fill[0]}={number}"], ["at", f"{r.randrange(24)}:{r.randrange(10, 60)}"],
                          [name, fill[0]], [name, "is", fill[1]], [fill[0] + ":", pick(letters, r.randrange(1, 20))], [fill[0], "=", fill[1]], [pick(letters, r.randrange(14, 30))], [name, pick(letters, r.randrange(9, 16))],
                          [name + ":", pick(letters, r.randrange(1, 6))], [name, "=", pick(letters, r.randrange(1, 6))], [fill[0].title() + fill[1].title() + fill[2].title()], [f"{fill[0]}_{fill[1]}"], [f"{fill[0]}&{fill[1]}"]))
        core = secret if r.random() < 0.5 else other
        words = [*fill[:3], *core, *fill[3:]]
        text = " ".join(words)
        whole = file_features(text)
        for places in runs(text):
            described, first = described_run(text, places)
            tags = [B if core is secret and value in text[a:b] else O for a, b in places]
            out.append(([word_features(described, first + i, whole) for i in range(len(places))], tags))
        out += [([word_features([PLAIN], 0, whole)], [O])] * 4
    return out


def fit(sequences: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by full gradients; sequences of one length are computed together."""
    index: dict[str, int] = {}
    for features, _ in sequences:
        for own in features:
            for f in own:
                index.setdefault(f, len(index))
    wide = max(len(own) for features, _ in sequences for own in features)
    none = len(index)
    groups: dict[int, list] = {}
    for features, tags in sequences:
        key = (tuple(tuple(index[f] for f in own) for own in features), tuple(tags))
        groups.setdefault(len(tags), {}).setdefault(key, 0)
        groups[len(tags)][key] += 1
    packed = []
    for n, own in groups.items():
        x = np.full((len(own), n, wide), none)
        for s, (features, _) in enumerate(own):
            for t, f in enumerate(features):
                x[s, t, :len(f)] = f
        packed.append((x, np.array([tags for _, tags in own]), np.array(list(own.values()), float)))
    total = sum(w.sum() for _, _, w in packed)
    weights, moves = np.zeros((none + 1, 3)), np.zeros((3, 3))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]

    def lse(v, axis):
        top = v.max(axis, keepdims=True)
        return (np.log(np.exp(v - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for step in range(1, rounds + 1):
        gw, gm = ridge * weights, ridge * moves
        for x, y, w in packed:
            s, n = y.shape
            e = weights[x].sum(2)
            alpha, beta = np.zeros((n, s, 3)), np.zeros((n, s, 3))
            alpha[0] = moves[O] + e[:, 0]
            for t in range(1, n):
                alpha[t] = lse(alpha[t - 1][:, :, None] + moves[None], 1) + e[:, t]
            beta[n - 1] = moves[:, O]
            for t in range(n - 2, -1, -1):
                beta[t] = lse(moves[None] + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
            z = lse(alpha[-1] + moves[:, O], 1)
            scale = w / total
            for t in range(n):
                p = np.exp(alpha[t] + beta[t] - z[:, None])
                p[np.arange(s), y[:, t]] -= 1
                p *= scale[:, None]
                for k in range(wide):
                    np.add.at(gw, x[:, t, k], p)
                if t == 0:
                    gm[O] += p.sum(0)
                if t == n - 1:
                    gm[:, O] += p.sum(0)
                if t:
                    pair = np.exp(alpha[t - 1][:, :, None] + moves[None] + (e[:, t] + beta[t])[:, None, :] - z[:, None, None])
                    gm += (pair * scale[:, None, None]).sum(0)
                    np.subtract.at(gm, (y[:, t - 1], y[:, t]), scale)
        for value, grad, a, b in ((weights, gw, *state[:2]), (moves, gm, *state[2:])):
            a *= 0.9
            a += 0.1 * grad
            b *= 0.99
            b += 0.01 * grad * grad
            value -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        weights[none] = 0
    return Field(index, weights, moves)


def train(docs: DataFrame, bound: int = 5_000, longest: int = 40, lines: int = 3_000) -> Field:
    """Fit on runs of at most ``bound`` documents (by id hash), none over ``longest`` words, and on generated lines.

    These are bounds of the training sample alone: a run of one and the same words counts at most 50
    times, so that copies of one document do not outweigh all others. Scanning has no bound.
    """

    own = narrow(docs, doc_id="long", text="string").where("doc_id IS NOT NULL")
    ids = sample_by_hash(own.select("doc_id").distinct(), bound)

    def run(batch: pa.RecordBatch):
        packed = []
        for text in texts(batch):
            for features, tags in tagged(text):
                if len(tags) <= longest:
                    packed.append("\x1d".join("\x1e".join([str(t), *f]) for f, t in zip(features, tags)))
        return rows(run=pa.array(packed, pa.string()))

    got = map_texts(own.join(F.broadcast(ids), "doc_id"), run, "run string").groupBy("run").count().toArrow()
    sequences = generated(lines)
    for line, count in sorted(zip(got.column("run").to_pylist(), got.column("count").to_pylist())):
        words = [w.split("\x1e") for w in line.split("\x1d")]
        sequences += [([w[1:] for w in words], [int(w[0]) for w in words])] * min(count, 50)
    return fit(sequences)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base array<struct>, spans array<struct>) of every whole text; places in code points, end exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(field)  # some hundred weights
    kind = "array<struct<start:long,end:long,kind:string>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batch: pa.RecordBatch):
        both = [all_spans(t, sent.value) for t in texts(batch)]
        base, spans = ([[{"start": a, "end": b, "kind": k} for a, b, k in pair[n]] for pair in both] for n in (0, 1))
        return rows(doc_id=batch.column("doc_id"), base=pa.array(base, span), spans=pa.array(spans, span))

    return map_texts(narrow(docs, doc_id="long", text="string"), run, f"doc_id long, base {kind}, spans {kind}")


def digest(docs: DataFrame, field: Field) -> DataFrame:
    spelled = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    count = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scan(docs, field).select("doc_id", *count, F.expr(f"sha2({spelled.format('base')}, 256)").alias("base_sha256"), F.expr(spelled.format("spans")).alias("spans"))


def redact(docs: DataFrame, field: Field, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mask``; all other columns as they were, n_chars counted anew."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def clean(text: str) -> str:
        out, done = [], 0
        for a, b, _ in all_spans(text, sent.value)[1]:
            if a >= done:
                out += [text[done:a], mask]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batch: pa.RecordBatch):
        done = pa.array([None if t is None else clean(t) for t in batch.column("text").to_pylist()], pa.string())
        out = batch.set_column(batch.schema.get_field_index("text"), "text", done)
        return out

    out = map_texts(docs, run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
