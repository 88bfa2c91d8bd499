from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return text.encode().lower().decode()


def shingles(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall(lower(text)) if text else []
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def components(nodes, links) -> dict:
    """Smallest node of each node's component."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def prose(r: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows, extra: bool = True):
    """documents, with columns that clash with names used inside the operators."""
    if extra:
        return spark.createDataFrame([(*row, "en", "src", 1, 2, b"z") for row in rows], "doc_id long, text string, lang string, source string, n long, fp long, hash binary")
    return spark.createDataFrame(rows, "doc_id long, text string")
