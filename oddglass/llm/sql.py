"""Pieces of check SQL that several queries share."""

from __future__ import annotations


def crc32(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text: eight shifts for each byte."""
    shift = "CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END"
    byte = f"list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda z, step: {shift})"
    codes = f"[ascii(c)::BIGINT for c in string_split({text}, '')]"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda crc, b: {byte}), 4294967295)"
