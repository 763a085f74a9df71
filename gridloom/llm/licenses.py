"""License scans with a positional rare-token index.

Each licence template is a paragraph of a licence's text, or a short way to
name it: a run of words with a key phrase that must stand in full. The rarest words of the key phrase, by how many documents of this
corpus hold them, are looked up in a document; the postings of those words,
shifted by their places in the template, must meet in one start; only there
are all words compared. So no place is missed, whichever words are rare. Two
linear passes over the texts and one aggregate of at most
``len(vocabulary)`` counts; no text is shuffled.

Defined results: null and empty texts have no words, places or labels and
score 0; places may overlap and all count; repeated rows keep a result each;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import small_batches


@dataclass(frozen=True)
class Template:
    label: str
    words: str  # in lower case, one space between
    base: bool = False
    key: str = ""  # words of the template that must stand there in full; empty: all of them
    least: float = 1.0  # share of the words that must agree
    parts: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        object.__setattr__(self, "parts", tuple(self.words.split()))


#: Words of licence texts, in lower case and without marks.
MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
MIT_NOTICE = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
MIT_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
BSD_TERMS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
ISC_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
APACHE_NOTICE = "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
APACHE_LIMITS = "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
GPL_NOTICE = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
MPL_NOTICE = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"
UNLICENSE = "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
ZLIB_GRANT = "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"

TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", key="granted free of charge", least=0.8),
    Template("mit", MIT_GRANT, key="granted free of charge", least=0.8),
    Template("mit", MIT_NOTICE, key="this permission notice shall be included", least=0.8),
    Template("mit", MIT_WARRANTY, key="fitness for a particular purpose and noninfringement", least=0.8),
    Template("apache-2", "licensed under the apache license version 2 0", key="apache license", least=0.8),
    Template("apache-2", APACHE_NOTICE, key="except in compliance with the license", least=0.8),
    Template("apache-2", APACHE_LIMITS, key="distributed on an as is basis", least=0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", key="source and binary forms", least=0.8),
    Template("bsd", BSD_TERMS, key="source and binary forms", least=0.8),
    Template("bsd", BSD_SOURCE, key="redistributions of source code must retain", least=0.8),
    Template("bsd", BSD_BINARY, key="redistributions in binary form must reproduce", least=0.8),
    Template("gpl", "gnu general public license", key="general public license", least=0.75),
    Template("gpl", GPL_NOTICE, key="redistribute it and or modify", least=0.8),
    Template("mpl-2", "mozilla public license version 2", key="mozilla public license", least=0.8),
    Template("mpl-2", MPL_NOTICE, key="subject to the terms of the mozilla public license", least=0.8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", key="copy modify and or distribute", least=0.8),
    Template("isc", ISC_GRANT, key="copy modify and or distribute", least=0.8),
    Template("cc-by", "licensed under a creative commons attribution license", key="creative commons attribution", least=0.8),
    Template("unlicense", "this is free and unencumbered software released into the public domain", key="free and unencumbered software", least=0.8),
    Template("unlicense", UNLICENSE, key="free and unencumbered software", least=0.8),
    Template("zlib", ZLIB_GRANT, key="permission is granted to anyone", least=0.8),
)
RARE = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def _lowered(column: pa.Array) -> tv.Words:
    """Words after lower-casing A to Z."""
    data, offs = tv.buffers(column)
    low = pa.Array.from_buffers(pa.string(), len(column), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(_LOWER[data])])
    return tv.words(low, _WORD)


def _heads(w: tv.Words) -> np.ndarray:
    """The first eight bytes of each word as a number; shorter words are filled with zeros."""
    padded = np.concatenate([w.data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(w.data) + 1, "<u8", padded, strides=(1,))
    return eight[w.start] & _MASK[np.minimum(w.end - w.start, 8)]


def _head(word: str) -> int:
    return int.from_bytes(word.encode()[:8].ljust(8, b"\0"), "little")


def _same(w: tv.Words, heads: np.ndarray, at: np.ndarray, word: str) -> np.ndarray:
    """Whether the words at ``at`` are ``word``."""
    raw = np.frombuffer(word.encode(), np.uint8)
    ok = (heads[at] == np.uint64(_head(word))) & (w.end[at] - w.start[at] == len(raw))
    if len(raw) > 8 and ok.any():
        some = np.flatnonzero(ok)
        ok[some] = (w.data[w.start[at[some]][:, None] + np.arange(8, len(raw))] == raw[8:]).all(1)
    return ok


def _key(t: Template) -> range:
    """The places of the words that must stand in full."""
    key = tuple(t.key.split()) or t.parts
    lead = next(i for i in range(len(t.parts)) if t.parts[i : i + len(key)] == key)
    return range(lead, lead + len(key))


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({x for t in templates for x in t.parts})


def document_frequency(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> dict[str, int]:
    """How many rows hold each licence word. Counted for words that agree in their first eight bytes, which only orders the lookups."""
    known = vocabulary(templates)
    heads = np.unique(np.array([_head(x) for x in known], np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(heads), np.int64)
        for batch in batches:
            column = tv.texts(batch.column(0))
            for a, z in tv.slices(column):
                w = _lowered(column.slice(a, z - a))
                h = _heads(w)
                slot = np.minimum(np.searchsorted(heads, h), len(heads) - 1)
                hit = heads[slot] == h
                total += np.bincount(np.unique(w.owner()[hit] * len(heads) + slot[hit]) % len(heads), minlength=len(heads))
        yield pa.record_batch([pa.array(range(len(heads)), pa.int32()), pa.array(total)], ["slot", "n"])

    got = {r.slot: r.n for r in docs.select(text_col).mapInArrow(tv.freeing(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    at = {int(h): i for i, h in enumerate(heads)}
    return {x: got.get(at[_head(x)], 0) for x in known}


def find(column: pa.Array, templates: tuple[Template, ...], df: dict[str, int]) -> tuple[tv.Words, list[tuple[np.ndarray, np.ndarray]]]:
    """Per template, the starts (indices of words in the slice) where it stands, and the share of words that agree."""
    w = _lowered(column)
    h = _heads(w)
    n = len(h)
    room = np.repeat(w.bound[1:], w.count)
    first = np.repeat(w.bound[:-1], w.count)
    rare = [sorted(_key(t), key=lambda i, t=t: (df.get(t.parts[i], 0), i))[:RARE] for t in templates]
    asked = np.unique(np.array([_head(t.parts[i]) for t, r in zip(templates, rare, strict=True) for i in r], np.uint64))
    slot = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
    hits = np.flatnonzero(asked[slot] == h)
    postings = {int(k): hits[slot[hits] == s] for s, k in enumerate(asked)}
    out = []
    for t, places in zip(templates, rare, strict=True):
        starts: np.ndarray | None = None
        for i in places:
            posted = postings[_head(t.parts[i])]
            posted = posted[_same(w, h, posted, t.parts[i])]
            # a start belongs to the text that holds the rare word
            own = posted[(posted - i >= first[posted]) & (posted - i + len(t.parts) <= room[posted])] - i
            starts = own if starts is None else np.intersect1d(starts, own, assume_unique=True)
        agree = np.zeros(len(starts))
        for i, word in enumerate(t.parts):
            agree += _same(w, h, starts + i, word)
        share = agree / len(t.parts)
        ok = share >= t.least
        for i in _key(t):
            ok &= _same(w, h, starts + i, t.parts[i])
        out.append((starts[ok], share[ok]))
    return w, out


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) of every row.

    ``places`` lists every (label, start word, share of words that agree); the
    best share is the score.
    """
    small_batches(docs.sparkSession)
    df = document_frequency(docs, templates, text_col)
    base = [t.base for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tv.texts(batch.column(1))
            for a, z in tv.slices(column):
                w, found = find(column.slice(a, z - a), templates, df)
                n = z - a
                hits: dict[int, list[tuple[int, int, float]]] = {}
                for k, (starts, share) in enumerate(found):
                    owner = np.searchsorted(w.bound, starts, "right") - 1
                    for d, s, x in zip(owner.tolist(), (starts - w.bound[owner]).tolist(), share.tolist(), strict=True):
                        hits.setdefault(d, []).append((s, k, x))
                n_base, first, last = [0] * n, [None] * n, [None] * n
                base_labels, labels, score, places = [""] * n, [""] * n, [0.0] * n, [[] for _ in range(n)]
                for d, got in hits.items():
                    own = [s for s, k, _ in got if base[k]]
                    n_base[d], first[d], last[d] = len(own), min(own, default=None), max(own, default=None)
                    base_labels[d] = ",".join(sorted({templates[k].label for _, k, _ in got if base[k]}))
                    labels[d] = ",".join(sorted({templates[k].label for _, k, _ in got}))
                    score[d] = round(max(x for _, _, x in got), 6)
                    places[d] = [{"label": templates[k].label, "start": s, "share": round(x, 6)} for s, k, x in sorted(got)]
                kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())]))
                yield pa.record_batch([batch.column(0).slice(a, n), pa.array(w.count), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score, pa.float64()), pa.array(places, kind)], names)

    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tv.freeing(run), f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:bigint,share:double>>")


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("places")
