"""Licence scan: a trained paragraph classifier, a calibrated unknown class, template comparison.

A paragraph is a line, or adjoining lines over which a notice is wrapped. Its words and word pairs are the sparse features of a multinomial logistic
regression over licence families and ``none``. It learns from the notices below, varied at random
with a fixed seed, from sentences that only use their words (``LOOKALIKES``), and from lines of at most
BACKGROUND_DOCS documents (the smallest by a hash of the id; lines that resemble a notice are left
out). Its confidence is calibrated by one temperature on variations and lines that it has not learned
from. A paragraph that is rather a licence than not is compared with the predicted family's notices;
if the calibrated probability or the resemblance is too low, its family is ``unknown``. That again has
to be confirmed: the paragraph must resemble some notice a little, or the form of a grant.

Notices of one licence's versions and variants differ in a word, so a family is only possible for a
paragraph that says the same of what tells them apart (``Facts``): version, number of clauses, terms
such as NonCommercial or Lesser. The prediction is made among the possible families, so a version that
has no notices here is ``unknown`` and not its nearest relative. The conditions that the two and three
clause licences begin with alike count for the latter, unless the paragraph names the number.

Lines that are not most of a notice by themselves are searched for wrapped notices: in runs of adjoining lines,
which a line without words ends (comment markers are no words), the windows of at most as many lines
as a notice has words that hold enough of its word pairs are judged as one paragraph. What is found there
takes the place of its lines' findings if it resembles its notice more than any of them.

Edge cases: null and empty texts have no paragraphs; repeated rows each give their findings; an
empty table learns from the notices alone and gives an empty result; null ids are kept; columns
other than the id and the text are ignored; very long texts are read whole; of families with equal
probability the first one is taken, of equal windows the shorter, then the earlier one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import text_of

NONE, UNKNOWN = "none", "unknown"
BACKGROUND_DOCS, BACKGROUND_LINES = 400, 3_000
VARIATIONS = 30
SEED = 20_240_603
LEAST_PROBABILITY, LEAST_RESEMBLANCE = 0.5, 0.6
LEAST_HINT = 0.6  # of a notice's or a grant's word pairs, for the family ``unknown``
WHOLE = 0.9  # a line that resembles a notice so much is all of it
WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")  # hyphenated words are parted, as lines may be wrapped there

# Notices of each family.
NOTICES: dict[str, list[str]] = {
    "MIT": [
        "MIT License",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "MIT-0": ["SPDX-License-Identifier: MIT-0", "MIT No Attribution"],
    "Apache-2.0": [
        "Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU General Public License version 2 or later",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD-3-Clause": [
        "BSD 3-Clause License",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1", "Licensed under the Mozilla Public License, Version 1.1.", "Mozilla Public License, Version 1.1"],
    "EPL-2.0": ["Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0"],
    "Zlib": ["zlib License", "Released under the zlib License.", "SPDX-License-Identifier: Zlib"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."],
    "ISC": ["ISC License", "Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0", "Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
#: Licence-like lines of no family, so that the classifier learns what the families do not share.
OTHER_NOTICES = ["Licensed under the {} License.", "Released under the terms of the {} Public License, version {}.", "All rights reserved by {}.", "SPDX-License-Identifier: {}"]
#: Sentences of no licence that use the words of one; gaps are filled at random.
LOOKALIKES = [
    "His driving license was revoked by the {} court.", "You need a {} license to fish in the river.", "The {} permission was granted to any person who asked for a copy.",
    "The software is free of charge for {} and {} users.", "Apache helicopters flew over the {} base.", "Students at MIT released a {} study this week.",
    "The general public may visit the {} garden.", "The {} foundation published a version of the report.", "Files and documents of the {} project are kept in the office.",
    "All copies of the {} book were sold under the old title.", "The license fee for {} was paid without delay.", "A licensed {} must follow the terms and conditions of the contract.",
    "The creative work of {} was shared in common rooms.", "This file is subject to the {} rules of the house.", "She released the {} under her own name.", "The source of the {} code is not known.",
]


#: Words that a licence's version stands next to, and words that name its terms.
VERSIONED = set("license licence licenses gnu general public gpl lgpl agpl apache mpl mozilla epl eclipse cc cc0 by nc sa nd attribution sharealike noncommercial noderivatives noderivs creative commons commercial alike derivatives derivs international unported".split())
TERMS = {"lesser": "lesser", "lgpl": "lesser", "library": "library", "affero": "affero", "agpl": "affero", "nc": "nc", "noncommercial": "nc", "sa": "sa", "sharealike": "sa", "nd": "nd", "noderivatives": "nd", "noderivs": "nd"}
SPLIT_TERMS = {("non", "commercial"): "nc", ("share", "alike"): "sa", ("no", "derivatives"): "nd", ("no", "derivs"): "nd"}
CLAUSES = {"2": "2", "two": "2", "simplified": "2", "3": "3", "three": "3", "4": "4", "four": "4", "0": "0", "zero": "0", "1": "1", "one": "1"}
NEARBY = 4  # words between a version and the licence it is of
GLUED = re.compile(r"(a?gpl|lgpl|apache|mpl|epl|bsd)v?([1-9](?:\.[0-9])?)")
SELF = re.compile(r"(.*)", re.S)
VERSION = re.compile(r"v?([0-9]{1,2}(?:\.[0-9]{1,2}){0,2})")


class Facts(NamedTuple):
    """What a paragraph says of the version, the number of clauses and the terms of a licence."""

    version: frozenset = frozenset()
    clauses: frozenset = frozenset()
    terms: frozenset = frozenset()


def facts_of(words: list[str]) -> Facts:
    parted = [x for w in words for x in (GLUED.fullmatch(w) or SELF.fullmatch(w)).groups()]
    near = [i for i, w in enumerate(parted) if w in VERSIONED]
    if not near and "bsd" not in parted:
        return Facts()
    version, clauses = set(), set()
    for i, w in enumerate(parted):
        if parted[i + 1 : i + 2] in (["clause"], ["clauses"]) or w == "simplified":
            clauses.add(CLAUSES.get(w, w))
        elif (m := VERSION.fullmatch(w)) and any(abs(i - j) <= NEARBY for j in near):
            version.add(re.sub(r"(?:\.0)+$", "", m[1]))
    terms = {TERMS[w] for w in parted if w in TERMS} | {t for pair, t in SPLIT_TERMS.items() if pair in zip(parted, parted[1:])}
    commons = not {"cc", "creative", "attribution"}.isdisjoint(parted)
    return Facts(frozenset(version), frozenset(clauses), frozenset(t for t in terms if commons or t not in ("nc", "sa", "nd")))


def words_of(line: str) -> list[str]:
    return WORD.findall(line.lower())


def grams_of(words: list[str]) -> set:
    """Words and word pairs."""
    return {*words, *zip(words, words[1:])}


def pairs_of(words: list[str]) -> set:
    return set(zip(["", *words], [*words, ""]))


class Sparse:
    """Rows of given features, each scaled to length 1, and a constant: only what is not zero is kept, by row and by feature."""

    def __init__(self, rows: list[list[int]], features: int):
        size = np.array([len(r) + 1 for r in rows], dtype=np.int64)
        self.shape = len(rows), features + 1
        self.column = np.array([j for r in rows for j in (*r, features)], dtype=np.int64)
        self.row = np.repeat(np.arange(len(rows)), size)
        value = 1 / np.sqrt(np.maximum(1, size - 1)).astype(np.float32)
        self.value = np.where(self.column == features, np.float32(1), np.repeat(value, size))[:, None]
        self.start = np.cumsum(size) - size
        self.order = np.argsort(self.column, kind="stable")
        self.used, self.first = np.unique(self.column[self.order], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.value * w[self.column], self.start) if self.shape[0] else np.zeros((0, w.shape[1]), dtype=w.dtype)

    def transposed_times(self, z: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[1], z.shape[1]), dtype=z.dtype)
        if self.shape[0]:
            out[self.used] = np.add.reduceat((self.value * z[self.row])[self.order], self.first)
        return out


class Classifier:
    """Sparse weights of the families, a temperature, and the notices' word pairs."""

    def __init__(self, background: list[str]):
        rng = np.random.default_rng(SEED)
        self.families = [*NOTICES, UNKNOWN, NONE]
        self.templates = {f: [pairs_of(words_of(n)) for n in notices] for f, notices in NOTICES.items()}
        self.facts = {f: [facts_of(words_of(n)) for n in notices] for f, notices in NOTICES.items()}
        self.notices = [t for f in NOTICES for t in self.templates[f]]
        self.notices_of: dict[tuple[str, str], list[int]] = {}
        for i, t in enumerate(self.notices):
            for pair in t:
                if all(pair):
                    self.notices_of.setdefault(pair, []).append(i)
        self.first_words = {a for a, _ in self.notices_of}
        self.grants = [g for n in OTHER_NOTICES if (g := {p for part in n.split("{}") for p in zip(words_of(part), words_of(part)[1:])})]
        lines = [w for line in background if (w := words_of(line)) and self._best(w, list(NOTICES))[1] < 0.5][:BACKGROUND_LINES]
        spare = np.array(sorted({w for line in lines for w in line}) or ["word"], dtype=object)
        rows, y = [], []
        for k, family in enumerate(self.families):
            for notice in NOTICES.get(family, OTHER_NOTICES if family == UNKNOWN else []):
                for _ in range(VARIATIONS):
                    filled = notice.replace("{}", " ".join(rng.choice(spare, rng.integers(1, 3)))) if family == UNKNOWN else notice
                    words = [w for w in words_of(filled) if rng.random() > 0.04]
                    around = rng.choice(spare, rng.integers(0, 6)) if rng.random() < 0.4 else []
                    cut = rng.integers(0, len(around) + 1)
                    rows.append([*around[:cut], *words, *around[cut:]])
                    y.append(k)
        for sentence in LOOKALIKES:
            for _ in range(VARIATIONS // 3):
                rows.append(words_of(re.sub(r"\{\}", lambda _: str(rng.choice(spare)), sentence)))
                y.append(len(self.families) - 1)
        rows += lines
        y += [len(self.families) - 1] * len(lines)
        order = rng.permutation(len(rows))
        learn, check = order[len(order) // 5 :], order[: len(order) // 5]
        known = {}
        for i in learn:
            if y[i] != len(self.families) - 1:
                for g in grams_of(rows[i]):
                    known[g] = known.get(g, 0) + 1
        self.feature = {g: j for j, g in enumerate(sorted((g for g, n in known.items() if n > 3), key=str))}
        self._fit([rows[i] for i in learn], np.array([y[i] for i in learn]), [rows[i] for i in check], np.array([y[i] for i in check]))
        # a line can only pass for a licence if it holds a gram that speaks for one
        gain = (self.weights[:, :-1] - self.weights[:, -1:]).max(axis=1)
        self.evidence = {w for g, j in self.feature.items() if gain[j] > 0 for w in ([g] if isinstance(g, str) else g)}

    def _matrix(self, rows: list[list[str]]) -> "Sparse":
        at = [[self.feature[g] for g in grams_of(words) if g in self.feature] for words in rows]
        return Sparse(at, len(self.feature))

    def _fit(self, rows, y, check_rows, check_y, rounds: int = 150, rate: float = 6.0, l1: float = 2e-5) -> None:
        x, goal = self._matrix(rows), np.eye(len(self.families), dtype=np.float32)[y]
        share = 1 / np.sqrt(np.maximum(1, np.bincount(y, minlength=len(self.families))))[y]
        share = (share / share.sum()).astype(np.float32)[:, None]
        w = before = np.zeros((len(self.feature) + 1, len(self.families)), dtype=np.float32)
        for k in range(rounds):
            ahead = w + k / (k + 3) * (w - before)
            step = ahead - rate * x.transposed_times(share * (softmax(x.times(ahead)) - goal))
            before, w = w, np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        self.weights, self.bias = w[:-1], w[-1]
        z = self._matrix(check_rows).times(w)
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(check_y)), check_y] + 1e-12).mean() if len(check_y) else t
        self.temperature = min(np.geomspace(0.05, 5, 60), key=loss)

    def _hinted(self, words: list[str], resemblance: float) -> bool:
        """Whether a paragraph of no certain family is like a licence at all: part of a notice, or a grant's form."""
        have = set(zip(words, words[1:]))
        return resemblance >= LEAST_HINT or any(len(g & have) >= LEAST_HINT * len(g) for g in self.grants)

    def _best(self, words: list[str], families: list[str]) -> tuple[str, float]:
        """The notice that is most nearly contained in ``words``: its family and the share of its word pairs."""
        have = {*zip(words, words[1:]), *(("", w) for w in words), *((w, "") for w in words)}
        return max(((f, len(t & have) / len(t)) for f in families for t in self.templates[f]), key=lambda x: x[1])

    def possible(self, words: list[str], family: str) -> bool:
        """Whether a paragraph says of version, clauses and terms what the family's notices say that it resembles most."""
        own = Facts(*(frozenset().union(*kind) for kind in zip(*self.facts[family])))
        if not any(own):
            return True
        said, have = facts_of(words), pairs_of(words)
        _, like = max(enumerate(self.templates[family]), key=lambda t: (len(t[1] & have) / len(t[1]), -t[0]))
        asked = self.facts[family][self.templates[family].index(like)]
        return all(not kind or x <= kind for x, kind in zip(said[:2], own)) and all(not kind or x for x, kind in zip(said[:2], asked)) and said.terms == own.terms

    def judge(self, words: list[str]) -> tuple[str, float, float] | None:
        """(family, calibrated probability, resemblance), or None if this is no licence."""
        if self.evidence.isdisjoint(words):
            return None
        at = [self.feature[g] for g in grams_of(words) if g in self.feature]
        if not at:
            return None
        p = softmax(((self.weights[at].sum(0) / len(at) ** 0.5 + self.bias) / self.temperature)[None])[0]
        if p[-1] >= LEAST_PROBABILITY:
            return None
        open_ = np.array([f not in NOTICES or self.possible(words, f) for f in self.families])
        p = p * open_ / p[open_].sum()
        k = int(p[:-1].argmax())
        family = self.families[k]
        resemblance = self._best(words, list(NOTICES) if family == UNKNOWN else [family])[1]
        if family != UNKNOWN and p[k] >= LEAST_PROBABILITY and resemblance >= LEAST_RESEMBLANCE:
            return family, float(p[k]), resemblance
        return (UNKNOWN, float(p[k]), resemblance) if self._hinted(words, resemblance) else None

    def windows(self, lines: list[list[str]]) -> list[tuple[int, int]]:
        """(first, last) of the adjoining lines that together may hold a wrapped notice, the fullest first; none overlap."""
        hits: dict[int, dict[int, set]] = {}  # notice, line: word pairs, that with the line before among them
        for k, words in enumerate(lines):
            before = lines[k - 1][-1:] if k else []
            if self.first_words.isdisjoint(words) and self.first_words.isdisjoint(before):
                continue
            for pair in zip([*before, *words], words if before else words[1:]):
                for i in self.notices_of.get(pair, ()):
                    hits.setdefault(i, {}).setdefault(k, set()).add(pair)
        found = []
        for i, by_line in hits.items():
            least = LEAST_RESEMBLANCE * len(self.notices[i]) - 2  # both ends may be there
            if len(by_line) < 2 or len(set().union(*by_line.values())) < least:
                continue
            at = sorted(by_line)
            cuts = [0, *(j for j in range(1, len(at)) if at[j] != at[j - 1] + 1), len(at)]
            todo = [(at[a], at[b - 1]) for a, b in zip(cuts, cuts[1:])]
            while todo:
                low, high = todo.pop()
                best, count, a = (0, low, low), {}, low
                for b in range(low, high + 1):
                    for pair in by_line[b]:
                        count[pair] = count.get(pair, 0) + 1
                    while a < b and (b - a >= len(self.notices[i]) or all(count[pair] > 1 for pair in by_line[a])):
                        for pair in by_line[a]:
                            count[pair] -= 1
                            if not count[pair]:
                                del count[pair]
                        a += 1
                    best = max(best, (len(count), -a, b), key=lambda x: x[0])
                share, a, b = best[0], abs(best[1]), best[2]
                if share < max(least, 1):
                    continue
                if b > a:
                    found.append((share / len(self.notices[i]), a, b))
                todo += [x for x in ((low, a - 1), (b + 1, high)) if x[0] < x[1]]
        taken: list[tuple[int, int]] = []
        for _, a, b in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            if all(b < c or a > d for c, d in taken):
                taken.append((a, b))
        return taken


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def findings(text: str, classifier: Classifier) -> list[tuple]:
    """(paragraph, start, end, family, probability, resemblance) of every licence paragraph; it has its first line's number."""
    out: dict[int, tuple] = {}
    run: list[tuple[int, int, int, list[str]]] = []  # adjoining lines that are no whole notice: number, start, end, words
    start = 0

    def search() -> None:
        if len(run) > 1:
            for a, b in classifier.windows([words for *_, words in run]):
                found = classifier.judge([w for *_, words in run[a : b + 1] for w in words])
                if found and found[2] > max(out[k][5] if k in out else 0 for k, *_ in run[a : b + 1]):
                    for k, *_ in run[a : b + 1]:
                        out.pop(k, None)
                    out[run[a][0]] = (run[a][0], run[a][1], run[b][2], *found)
        run.clear()

    for k, line in enumerate(text.split("\n")):
        words, end = words_of(line), start + len(line)
        if words and (found := classifier.judge(words)):
            out[k] = (k, start, end, *found)
        if words and (k not in out or out[k][5] < WHOLE):
            run.append((k, start, end, words))
        else:
            search()
        start = end + 1
    search()
    return [out[k] for k in sorted(out)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """A classifier with lines of at most BACKGROUND_DOCS documents as background."""
    one_in = docs.count() // (4 * BACKGROUND_DOCS) + 1  # so that tasks send few ids each, however many tasks there are
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_pick")).where(F.pmod(F.xxhash64("_pick"), F.lit(one_in)) == 0).orderBy(F.xxhash64("_pick"), "_pick").limit(BACKGROUND_DOCS)
    picked = [r["_pick"] for r in ids.collect()]  # bounded by BACKGROUND_DOCS
    one_each = docs.where(F.col(id_col).isin(picked)).groupBy(F.col(id_col).alias("_pick")).agg(F.min(text_of(text_col)).alias("text"))  # ids may be repeated
    rows = one_each.collect() if picked else []
    lines = sorted({line for r in rows for line in r["text"].split("\n") if line.strip()})
    np.random.default_rng(SEED).shuffle(lines)
    return Classifier(lines[:BACKGROUND_LINES])


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per licence paragraph: id, paragraph, start, end (code points), license, probability, resemblance."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1)):
                got = findings(value.as_py(), classifier)
                at += [i] * len(got)
                rows += got
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["_id", "paragraph", "start", "end", "license", "probability", "resemblance"])

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, paragraph int, start long, end long, license string, probability double, resemblance double"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
