"""Texts and views that several tests share."""

from __future__ import annotations


def prose(seed: int, n: int) -> str:
    """Words that hardly repeat, in lines that end like sentences."""
    words = [f"w{(seed * 7919 + i * i * 31 + i) % 100003}" for i in range(n)]
    lines = [" ".join(words[i : i + 12]) + "." for i in range(0, n, 12)]
    return "\n".join(lines)


def texts_of(df) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
