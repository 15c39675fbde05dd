"""License scan: ordered signature rules behind a keyword prefilter.

Texts become word sequences (A-Z lower-cased; words are runs of letters, digits and non-ASCII bytes), joined
by single blanks, and the rules are regexes over that form. An Aho-Corasick automaton over the rules'
keywords finds which rules can match at all; only those are run. Their detections are ordered by
priority, then length, then place and rule; one whose words lie within a kept detection's is suppressed.
The four base phrases are counted apart: they are facts about the words and are never suppressed.

Defined results. Null and empty texts have no words, no labels and score 0. Repeated rows each get
their result. Documents are handled one by one in Arrow batches; a long text costs its own length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import buffers, fresh, per_row, small_batches, word_starts, word_table

#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str


class Detection(NamedTuple):
    label: str
    priority: int
    start: int
    end: int
    order: int


#: Families: label stem, keywords (joined by |; one of them stands in every form of the name, and each alternative starts a word), how the name is written, the versions there are, priority.
FAMILIES = (
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", ("1", "2", "3"), 50),
    ("lgpl", "lesser general|library general", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", ("2", "2.1", "3"), 60),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", ("1", "3"), 60),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", ("1.1", "1.2", "1.3"), 50),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", ("1", "1.1", "2", "2.0"), 50),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ("1", "1.1", "2", "2.0"), 50),
    ("epl", "eclipse", r"eclipse public licen[sc]e", ("1", "1.0", "2", "2.0"), 50),
    ("cddl", "development and distribution", r"common development and distribution licen[sc]e", ("1", "1.0", "1.1"), 50),
    ("eupl", "european union", r"european union public licen[sc]e", ("1", "1.1", "1.2"), 50),
    ("osl", "open software", r"open software licen[sc]e", ("1", "1.1", "2", "2.1", "3", "3.0"), 50),
    ("afl", "academic free", r"academic free licen[sc]e", ("1.1", "1.2", "2", "2.1", "3", "3.0"), 50),
    ("artistic", "artistic", r"artistic licen[sc]e", ("1", "1.0", "2", "2.0"), 50),
    ("bsl", "boost", r"boost software licen[sc]e", ("1", "1.0"), 50),
    ("python", "python", r"python (?:software foundation )?licen[sc]e", ("2", "2.0"), 50),
    ("cecill", "cecill", r"cecill(?: free software)?(?: licen[sc]e)?", ("1", "1.1", "2", "2.1"), 50),
    ("apsl", "apple public", r"apple public source licen[sc]e", ("1", "1.0", "1.1", "1.2", "2", "2.0"), 50),
    ("cpl", "common public", r"common public licen[sc]e", ("1", "1.0"), 50),
    ("ipl", "ibm public", r"ibm public licen[sc]e", ("1", "1.0"), 50),
    ("lppl", "latex project", r"latex project public licen[sc]e", ("1", "1.0", "1.1", "1.2", "1.3", "1.3a", "1.3c"), 50),
    ("odbl", "open database", r"open database licen[sc]e", ("1", "1.0"), 50),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", ("1", "1.0", "1.1"), 50),
    ("php", "php", r"php licen[sc]e", ("3", "3.0", "3.01"), 50),
    ("zpl", "zope", r"zope public licen[sc]e", ("1.1", "2", "2.0", "2.1"), 50),
    ("upl", "universal permissive", r"universal permissive licen[sc]e", ("1", "1.0"), 50),
    ("qpl", "q public", r"q public licen[sc]e", ("1", "1.0"), 50),
    ("rpl", "reciprocal public", r"reciprocal public licen[sc]e", ("1.1", "1.5"), 50),
    ("sspl", "server side", r"server side public licen[sc]e", ("1", "1.0"), 50),
    ("busl", "business source", r"business source licen[sc]e", ("1", "1.0", "1.1"), 50),
)
#: Creative Commons: the short code, and the long name after "attribution".
CC_PARTS = (("by", ""), ("by-sa", "share ?alike"), ("by-nc", "non ?commercial"), ("by-nd", "no ?deriv(?:ative)?s?(?: works)?"), ("by-nc-sa", "non ?commercial share ?alike"), ("by-nc-nd", "non ?commercial no ?deriv(?:ative)?s?(?: works)?"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Sentences and short names that stand for a license: label, priority, keywords (joined by |), regex.
PLAIN = (
    ("mit", 40, "mit", r"(?:the )?mit licen[sc]e"),
    ("mit", 45, "mit", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit(?: licen[sc]e)?"),
    ("mit", 30, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 30, "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", 40, "isc", r"isc licen[sc]e"),
    ("bsd", 30, "redistribution and use", r"redistribution and use in source and binary forms"),
    ("bsd", 40, "bsd", r"bsd(?: style)? licen[sc]e"),
    ("bsd-2-clause", 55, "bsd|freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", 55, "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", 35, "neither the name", r"neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors"),
    ("0bsd", 55, "bsd|0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?"),
    ("zlib", 40, "zlib", r"zlib (?:libpng )?licen[sc]e"),
    ("unlicense", 40, "unlicense", r"(?:the )?unlicense"),
    ("unlicense", 35, "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 40, "wtfpl", r"wtfpl"),
    ("public-domain", 20, "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("cc0", 45, "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("all-rights-reserved", 20, "all rights reserved", r"(?:copyright(?: [^ ]+){0,8} )?all rights reserved"),
    ("copyright", 5, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: [^ ]+){0,4}"),
    ("proprietary", 20, "proprietary", r"proprietary and confidential"),
    ("gpl", 40, "gpl", r"(?:gnu )?gpl"),
    ("lgpl", 40, "lgpl", r"(?:gnu )?lgpl"),
    ("agpl", 40, "agpl", r"(?:gnu )?agpl"),
    ("spdx", 10, "spdx", r"spdx license identifier [^ ]+(?: [^ ]+){0,3}"),
    ("postgresql", 40, "postgresql", r"postgresql licen[sc]e"),
    ("ncsa", 40, "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("vim", 40, "vim", r"vim licen[sc]e"),
    ("ms-pl", 40, "microsoft public", r"microsoft public licen[sc]e"),
    ("ms-rl", 40, "microsoft reciprocal", r"microsoft reciprocal licen[sc]e"),
    ("blue-oak", 40, "blue oak", r"blue oak model licen[sc]e"),
)


def _version(v: str) -> str:
    return v.replace(".", " ")


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules in order. Families and versions are spelled out here; each version has a long, a short and an SPDX form."""
    out = [Rule(label, priority, tuple(word.split("|")), pattern) for label, priority, word, pattern in PLAIN]
    for stem, word, name, versions, priority in FAMILIES:
        words = tuple(word.split("|"))
        out.append(Rule(stem, priority, words, name))
        for v in versions:
            tail = rf"(?:,? ?(?:version|v) ?)?{_version(v)}"
            out.append(Rule(f"{stem}-{v}", priority + 10, words, rf"{name} (?:version |v ?)?{_version(v)}(?: 0)?"))
            out.append(Rule(f"{stem}-{v}", priority + 10, (stem,), rf"{stem} ?{tail}(?: only| or later)?"))
            out.append(Rule(f"{stem}-{v}-or-later", priority + 20, words, rf"{name}(?: as published by [^ ]+(?: [^ ]+){{0,5}})? (?:version |v ?)?{_version(v)} or (?:any |\(?at your option\)? ?any )?later(?: version)?"))
    for code, long in CC_PARTS:
        short = code.replace("-", " ")
        out.append(Rule(f"cc-{code}", 42 + 2 * len(code), ("cc by",), rf"cc {short}"))
        out.append(Rule(f"cc-{code}", 42 + 2 * len(code), ("creative commons",), rf"creative commons attribution{' ' + long if long else ''}(?: international| unported)?(?: licen[sc]e)?"))
        for v in CC_VERSIONS:
            out.append(Rule(f"cc-{code}-{v}", 60 + 2 * len(code), ("cc by",), rf"cc {short} {_version(v)}(?: international| unported)?"))
            out.append(Rule(f"cc-{code}-{v}", 60 + 2 * len(code), ("creative commons",), rf"creative commons attribution{' ' + long if long else ''} {_version(v)}(?: international| unported)?(?: licen[sc]e)?"))
    return tuple(out)


@lru_cache(1)
def _engine():
    import ahocorasick

    gate = ahocorasick.Automaton()
    by_word: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for word in r.keywords:
            by_word.setdefault(word, []).append(i)
    for word, of in by_word.items():
        gate.add_word(word, tuple(of))
    gate.make_automaton()
    compiled = [re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in rules()]
    return gate, compiled


def unsuppressed(found: list[Detection]) -> list[Detection]:
    """By priority, length, place and rule; without those whose words lie within one kept before.

    The farthest end of those kept that start at or before a place is found in a tree of prefix maxima, so a text full of licenses
    takes n log n steps.
    """
    starts = sorted({d.start for d in found})
    farthest = [0] * (len(starts) + 1)
    kept: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.order)):
        place = i = bisect_right(starts, d.start)
        end = 0
        while i:
            end = max(end, farthest[i])
            i &= i - 1
        if end < d.end:
            kept.append(d)
            while place < len(farthest):
                farthest[place] = max(farthest[place], d.end)
                place += place & -place
    return kept


def detect(words: str) -> list[Detection]:
    """Detections kept in a word sequence joined by blanks; start and end count words."""
    gate, compiled = _engine()
    found = []
    blanks = [m.start() for m in re.finditer(" ", words)]
    for i in sorted({i for _, of in gate.iter(words) for i in of}):
        for m in compiled[i].finditer(words):
            start = bisect_right(blanks, m.start())
            found.append(Detection(rules()[i].label, rules()[i].priority, start, start + m[0].count(" ") + 1, i))
    return unsuppressed(found)


def base_places(words: str) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase stands."""
    text, out = f" {words} ", []
    blanks = [m.start() for m in re.finditer(" ", text)]
    for phrase, label in BASE:
        at = text.find(f" {phrase} ")
        while at >= 0:
            out.append((bisect_left(blanks, at), label))
            at = text.find(f" {phrase} ", at + 1)
    return sorted(out)


_BLANKS = bytes(c if inside else 0x20 for c, inside in enumerate(word_table()))


@lru_cache(1)
def _prefilter() -> re.Pattern[bytes]:
    """First words of all keywords and base phrases, over lower-cased bytes: which documents to look into."""
    first = {w.split(" ")[0] for r in rules() for w in r.keywords} | {p.split(" ")[0] for p, _ in BASE}
    stems = sorted(first, key=len)
    stems = [w for i, w in enumerate(stems) if not any(w.startswith(v) for v in stems[:i])]
    return re.compile(b"(?<![a-z0-9\x80-\xff])(?:" + b"|".join(sorted(w.encode() for w in stems)) + b")")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside = word_table()
    for batch in batches:
        *keys, text = batch.columns
        data, at, _ = buffers(text)
        low = data.tobytes().lower()
        starts = word_starts(inside[np.frombuffer(low, np.uint8)], at)
        n_words = per_row(starts, at)
        n = len(at) - 1
        base_n, first, last, score = np.zeros(n, np.int64), [None] * n, [None] * n, np.zeros(n)
        base_labels, labels, spans = [""] * n, [""] * n, [[] for _ in range(n)]
        apart = b"\n".join(low[at[i] : at[i + 1]] for i in range(n))  # so that no word runs on into the next text
        places = np.fromiter((m.start() for m in _prefilter().finditer(apart)), np.int64)
        for i in np.unique(np.searchsorted(at[:-1] + np.arange(n), places, "right") - 1).tolist():
            words = b" ".join(low[at[i] : at[i + 1]].translate(_BLANKS).split()).decode()
            if base := base_places(words):
                base_n[i], first[i], last[i] = len(base), base[0][0], base[-1][0]
                base_labels[i] = ",".join(sorted({label for _, label in base}))
            kept = detect(words)
            labels[i] = ",".join(sorted({label for _, label in base} | {d.label for d in kept}))
            spans[i] = [{"label": d.label, "start": d.start, "end": d.end} for d in sorted(kept, key=lambda d: (d.start, d.end, d.order))]
            score[i] = max([min(1.0, d.priority / 80) for d in kept], default=0.5 if base else 0.0)
        yield pa.RecordBatch.from_arrays(
            [*keys, pa.array(n_words, pa.int64()), pa.array(base_n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score), pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))],
            names=[*batch.schema.names[:-1], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
        )


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its id, word and base counts, labels, score, and ``detections`` (label, start, end in words).

    score is the highest priority kept, out of 80, and 0.5 where only a base phrase was found.
    """
    small_batches(docs.sparkSession)
    key = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {key}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label:string,start:int,end:int>>"
    return docs.select(doc_id, docs[text].cast("string").alias(fresh(docs, "_text"))).mapInArrow(_scan, schema)
