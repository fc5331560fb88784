"""Operator 11: licence notices found by a positional index of rare tokens.

Templates' words are known with their positions. The words of a template that are rarest in all texts are its anchors:
where a file has one, the difference of both positions says where the whole template would begin, and its other words
are looked for at the places that follow. What is found is accepted if enough of the template stands there and its key
phrases stand there unbroken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import batches_of, key_text, per_batch, type_of
from isotherm.llm.words import Split, Vocabulary

#: Phrases and the labels of the texts they stand in.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, notice, phrases without which it is not that notice. The notices are those that public licences ask to be put into files.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ("gnu general public license", "free software foundation")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)

#: Anchors of a notice; words that may be missing or added in between before a part no longer counts as the same place; the share of a notice that has to be there.
ANCHORS, SLACK, COVERAGE = 4, 8, 0.7
#: Places that are held against templates at once.
STEP = 1 << 13


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[int, ...]
    keys: tuple[tuple[int, ...], ...]
    base: bool


class Index:
    """Templates by word and position. idf: of each word, over all texts; without it all words are alike."""

    def __init__(self, phrases=PHRASES, notices=NOTICES, idf: dict[bytes, float] | None = None, anchors: int = ANCHORS):
        texts = [p for p, _ in phrases] + [t for _, t, _ in notices] + [k for _, _, keys in notices for k in keys]
        self.vocabulary = Vocabulary(sorted({w for t in texts for w in t.encode().split()}))
        number = {w: k for k, w in enumerate(self.vocabulary.words)}
        of = lambda t: tuple(number[w] for w in t.encode().split())
        self.templates = [Template(label, of(t), (of(t),), True) for t, label in phrases] + [Template(label, of(t), tuple(map(of, keys)), False) for label, t, keys in notices]
        self.idf = np.array([(idf or {}).get(w, 1.0) for w in self.vocabulary.words])
        # postings: for each word, (template, position) where it is an anchor
        self.postings: list[list[tuple[int, int]]] = [[] for _ in number]
        for t, tpl in enumerate(self.templates):
            rarest = sorted(set(tpl.words), key=lambda w: (-self.idf[w], w))[: 1 if tpl.base else anchors]
            for p, w in enumerate(tpl.words):
                if w in rarest:
                    self.postings[w].append((t, p))
        self.anchor = np.array([bool(x) for x in self.postings])

    def starts(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Where each template would begin, by its anchors among the words `ids`: sorted, each once. They can lie before the first word."""
        found: dict[int, list[np.ndarray]] = {}
        at = np.flatnonzero(ids >= 0)
        at = at[self.anchor[ids[at]]]
        for w in np.unique(ids[at]):
            places = at[ids[at] == w]
            for t, p in self.postings[w]:
                found.setdefault(t, []).append(places - p)
        return {t: np.unique(np.concatenate(x)) for t, x in found.items()}


def stands(ids: np.ndarray, row: np.ndarray, phrase: tuple[int, ...], at: np.ndarray) -> np.ndarray:
    """Whether the words of a phrase stand at each of some places, in one row."""
    ok = (at >= 0) & (at + len(phrase) <= len(ids))
    safe = np.where(ok, at, 0)
    for k, w in enumerate(phrase):
        place = np.minimum(safe + k, len(ids) - 1)
        ok &= (ids[place] == w) & (row[place] == row[safe])
    return ok


def scan(split: Split, index: Index) -> dict[str, list]:
    """Of each row: places of base phrases, the first and last, labels, and the score."""
    rows = len(split.first) - 1
    ids, row = index.vocabulary.find(split), split.row
    n_base, score = np.zeros(rows, np.int64), np.zeros(rows)
    first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    base: list[set] = [set() for _ in range(rows)]
    more: list[set] = [set() for _ in range(rows)]
    for t, starts in index.starts(ids).items():
        tpl = index.templates[t]
        if tpl.base:
            at = starts[stands(ids, row, tpl.words, starts)] if len(starts) else starts
            of = row[at]
            n_base += np.bincount(of, minlength=rows)
            np.minimum.at(first, of, at - split.first[of])
            np.maximum.at(last, of, at - split.first[of])
            score[of] = 1.0
            for r in np.unique(of):
                base[r].add(tpl.label)
            continue
        for r, share in accepted(ids, row, split.first, tpl, index, t, starts):
            more[r].add(tpl.label)
            score[r] = max(score[r], share)
    has = n_base > 0
    return {
        "n_words": np.diff(split.first), "n_base": n_base,
        "first_word": [int(x) if y else None for x, y in zip(first, has, strict=True)], "last_word": [int(x) if y else None for x, y in zip(last, has, strict=True)],
        "base_labels": [",".join(sorted(x)) for x in base], "labels": [",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)], "score": score,
    }


def accepted(ids: np.ndarray, row: np.ndarray, first: np.ndarray, tpl: Template, index: Index, t: int, starts: np.ndarray):
    """Rows that hold a notice, and the largest share of it that stands at one place.

    A place is a start that an anchor gives in the anchor's own row, together with the starts up to SLACK words after
    it: of the template's words, those count that stand where one of these starts has them.
    """
    size = len(tpl.words)
    words = np.array(tpl.words)
    anchored = np.array([p for w in set(tpl.words) for x, p in index.postings[w] if x == t])
    best: dict[int, float] = {}
    # a start counts in each row that one of its anchors stands in: with anchors at several positions these can be two
    own, where = [], []
    for p in anchored:
        place = starts + p
        ok = (place >= 0) & (place < len(ids))
        ok[ok] = ids[place[ok]] == words[p]
        own.append(starts[ok])
        where.append(row[place[ok]])
    pairs = np.unique(np.stack([np.concatenate(where).astype(np.int64), np.concatenate(own).astype(np.int64)]), axis=1)
    for begin in range(0, pairs.shape[1], STEP):
        rows, at = pairs[:, begin : begin + STEP + SLACK]
        place = at[:, None] + np.arange(size)
        ok = (place >= 0) & (place < len(ids))
        place = np.where(ok, place, 0)
        ok &= (ids[place] == words) & (row[place] == rows[:, None])
        n = min(STEP, len(at))
        union = ok[:n].copy()
        for k in range(1, min(SLACK, len(at) - 1) + 1):
            m = min(n, len(at) - k)
            near = (rows[k : k + m] == rows[:m]) & (at[k : k + m] - at[:m] <= SLACK)
            union[:m] |= ok[k : k + m] & near[:, None]
        share = union.mean(axis=1)
        for k in np.flatnonzero(share >= COVERAGE):
            r, low = int(rows[k]), max(int(at[k]), int(first[rows[k]]))
            high = min(int(at[k]) + size + SLACK, int(first[rows[k] + 1]))
            span = np.arange(low, high)
            if share[k] > best.get(r, 0.0) and all(stands(ids, row, key, span[: max(0, len(span) - len(key) + 1)]).any() for key in tpl.keys):
                best[r] = float(share[k])
    return best.items()


def document_frequencies(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all texts each licence word stands, and how many texts there are; the driver gets one number for each word."""

    def work(batches):
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            split = Split(batch.column("text"))
            ids = vocabulary.find(split)
            some = np.flatnonzero(ids >= 0)
            pairs = np.unique(split.row[some].astype(np.int64) * len(vocabulary) + ids[some])
            total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            n += batch.num_rows
        yield {"word": [*range(len(vocabulary)), -1], "n": [*total.tolist(), n]}

    out, n = np.zeros(len(vocabulary), np.int64), 0
    for word, count in batches_of(df.select(F.col(f"`{text}`").cast("string").alias("text")), work, "word int, n long").groupBy("word").agg(F.sum("n")).collect():
        if word < 0:
            n = count
        else:
            out[word] = count
    return out, n


def index_of(df: DataFrame, text: str = "text", phrases=PHRASES, notices=NOTICES) -> Index:
    """The index of templates, with anchors that are rarest in all texts of df."""
    words = Index(phrases, notices).vocabulary
    counts, n = document_frequencies(df, words, text)
    return Index(phrases, notices, {w: math.log((n + 1) / (c + 1)) for w, c in zip(words.words, counts.tolist(), strict=True)})


def licenses(df: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    n_base counts all places where the words of a phrase stand consecutively, first_word and last_word are the smallest
    and largest of their starts, in words from 0, null without any. labels has those of phrases and of the notices that
    are accepted, each once, sorted and joined by commas; without any it is empty. score is 1 if a phrase stands in the
    text, else the largest share of an accepted notice, else 0. Null and empty texts have no words. Rows are neither
    added nor lost: repeated and null keys, and equal texts, each give a row. Other columns are ignored.
    """
    index = index_of(df, text, phrases, notices)
    schema = f"key {type_of(df, key)}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return per_batch(key_text(df, key, text), lambda batch: {"key": batch.column("key")} | scan(Split(batch.column("text")), index), schema).withColumnRenamed("key", key)
