"""Licences in texts by sentence rules: sentences become identifiers, sequences of identifiers become licences.

Sentences end at ``.``, ``!``, ``?``, ``:`` or ``;`` before white space or the text's end, or after an address, and start after such an end or
at a line's start, so that a sentence may run over lines and may follow an unfinished line. A sentence is normalised (lower
case, letters and digits only, one blank between, addresses, '(the "License")' and the subject before "is licensed under"
dropped) and looked up among the known sentences, alone and joined with those that follow it ("v. 2.0" has an end). The
identifiers in the order of the text are then matched against the rules, longest first, each identifier used once.

Defined cases: a null text is an empty one and has no licence. Every row gives one row; repeated rows and null ids are kept. A
licence that is named twice is reported once, in order of appearance. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.flat import parts

# Names of licences in normalised form, and their public identifiers.
NAMES = {
    "mit license": "MIT",
    "mit licence": "MIT",
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0 license": "Apache-2.0",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "gnu gpl version 2": "GPL-2.0",
    "gnu gpl version 3": "GPL-3.0",
    "gnu lesser general public license version 2 1": "LGPL-2.1",
    "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "eclipse public license version 2 0": "EPL-2.0",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "isc license": "ISC",
    "unlicense": "Unlicense",
    "boost software license version 1 0": "BSL-1.0",
    "zlib license": "Zlib",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "cc by nd 4 0": "CC-BY-ND-4.0",
    "cc by nc sa 4 0": "CC-BY-NC-SA-4.0",
    "cc0 1 0": "CC0-1.0",
    "creative commons attribution 4 0 international license": "CC-BY-4.0",
    "creative commons attribution sharealike 4 0 international license": "CC-BY-SA-4.0",
    "creative commons attribution noncommercial 4 0 international license": "CC-BY-NC-4.0",
}

# Known sentences of licence texts in normalised form.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-form",
    "this is free and unencumbered software released into the public domain": "unlicense-free",
}

#: Ordered rules over identifiers; a name's identifier is ``name:`` and the licence, and is a rule of its own.
RULES = (
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"), "BSD-2-Clause"),
    (("mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("name:Apache-2.0", "apache-comply", "apache-copy"), "Apache-2.0"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("isc-grant",), "ISC"),
    (("gpl2-later",), "GPL-2.0-or-later"),
    (("gpl3-later",), "GPL-3.0-or-later"),
    (("mpl2-form",), "MPL-2.0"),
    (("unlicense-free",), "Unlicense"),
)

#: Every known sentence holds one of these; the test is by a linear automaton and case-insensitive.
ANCHOR = r"licen[sc]ed under|released under|distributed under|available under|subject to|permission (?:is|to|notice)|permitted|redistribut\w+ (?:of|in|it|and)|neither the name|provided (?:as|by|\W?as)|may (?:not|obtain)|public domain|free software|SPDX"
_ANCHOR = re.compile(ANCHOR.replace(" ", r"\s+"), re.IGNORECASE)
_ANY = "(?i)" + ANCHOR.replace(" ", r"\s+")
_URL = r"https?://\S+"
_END = re.compile(rf"[.!?:;](?=\s|$)|{_URL}", re.IGNORECASE)
_UNDER = re.compile(
    r"^(?:(?:this|the) (?:\w+ ){1,3}(?:is|are) )?(?:licensed|licenced|released|distributed|available|made available) under (?:the terms of )?(?:the )?(.+)$"
)
_SPDX = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)")


#: A word, or what is dropped.
_TOKEN = re.compile(rf"{_URL}|\(the\s+[\"'“”]*licen[sc]e[\"'“”]*\)|([A-Za-z0-9]+)", re.IGNORECASE)
_SUBJECT_WORDS = 12
#: First words of the known sentences.
_FIRST = {tuple(x.split()[:2]) for x in SENTENCES}
_MOST_WORDS = max(len(x.split()) for x in (*SENTENCES, *NAMES)) + _SUBJECT_WORDS


def identifier(text: str, start: int, end: int) -> str | None:
    """The identifier of the sentence ``text[start:end]``; a sentence of more words than any known one is not read to its end."""
    words = [m[1].lower() for m in islice(_TOKEN.finditer(text, start, end), _MOST_WORDS + 1) if m[1]]
    sentence = " ".join(words)
    if sentence in SENTENCES:
        return SENTENCES[sentence]
    if (m := _UNDER.match(sentence)) and m[1] in NAMES:
        return f"name:{NAMES[m[1]]}"
    return None


def joined(text: str, start: int, ends: list[int], k: int) -> tuple[int, str] | None:
    """End and identifier of the known sentence that runs from ``start`` over ``ends[k]`` to a later end."""
    words: list[str] = []
    for m in islice(_TOKEN.finditer(text, start), _MOST_WORDS + 1):
        while k < len(ends) and ends[k] <= m.start():
            if known := SENTENCES.get(" ".join(words)):
                return ends[k], known
            k += 1
        if m[1]:
            words.append(m[1].lower())
            if len(words) == 2 and tuple(words) not in _FIRST:
                return None
    known = SENTENCES.get(" ".join(words))
    return (ends[k] if k < len(ends) else len(text), known) if known else None


def identifiers(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, identifier)`` of the known sentences; only sentences around an anchor are looked at."""
    found: dict[tuple[int, int], str] = {}
    looked: set[tuple[int, int]] = set()
    ends = [m.end() for m in _END.finditer(text)] if _ANCHOR.search(text) else []
    k = 0
    for anchor in _ANCHOR.finditer(text):
        while k < len(ends) and ends[k] <= anchor.start():
            k += 1
        floor, end = ends[k - 1] if k else 0, ends[k] if k < len(ends) else len(text)
        start, words = anchor.start(), 0
        while words <= _MOST_WORDS:  # line starts, nearest first, then the sentence's own start
            if (start == floor or text[start - 1] == "\n") and (start, end) not in looked:
                looked.add((start, end))
                if known := identifier(text, start, end):
                    found[start, end] = known
                elif k < len(ends) and (longer := joined(text, start, ends, k)):
                    found[start, longer[0]] = longer[1]
            if start <= floor:
                break
            line = max(text.rfind("\n", floor, start - 1) + 1, floor)
            words += sum(1 for _ in islice(_TOKEN.finditer(text, line, start), _MOST_WORDS + 1))
            start = line
    nearest: dict[tuple[int, str], int] = {}  # blank lines and subjects before a sentence do not repeat it
    for (start, end), known in found.items():
        nearest[end, known] = max(start, nearest.get((end, known), start))
    out = [(start, end, known) for (end, known), start in nearest.items()]
    out += [(m.start(), m.end(), f"name:{m[1]}") for m in _SPDX.finditer(text)]
    return sorted(out)


def licences(found: list[str]) -> list[str]:
    """Licences of a sequence of identifiers."""
    out: list[str] = []
    at = 0
    while at < len(found):
        for rule, licence in sorted(RULES, key=lambda r: -len(r[0])):
            if tuple(found[at : at + len(rule)]) == rule:
                out.append(licence)
                at += len(rule)
                break
        else:
            if found[at].startswith("name:"):
                out.append(found[at][5:])
            at += 1
    return list(dict.fromkeys(out))


def find_licences(docs: DataFrame) -> DataFrame:
    """``doc_id, sentences, licenses`` per row: arrays of (start, end, identifier) and of licences."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("id", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                texts = batch.column("text").fill_null("")
                sentences: list[list] = [[] for _ in range(batch.num_rows)]
                names: list[list] = [[] for _ in range(batch.num_rows)]
                for i in pc.indices_nonzero(pc.match_substring_regex(texts, _ANY)).to_pylist():
                    found = identifiers(texts[i].as_py())
                    sentences[i] = [{"start": s, "end": e, "id": known} for s, e, known in found]
                    names[i] = licences([known for _, _, known in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sentences, kind), pa.array(names, pa.list_(pa.string()))],
                    names=["doc_id", "sentences", "licenses"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, sentences array<struct<start: int, end: int, id: string>>, licenses array<string>")
