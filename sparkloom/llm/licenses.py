"""Licence scan: Dice coefficient over word bigrams against templates.

A text is compared as a whole, in blocks (cut at empty lines) and in lines.  Each
such segment is normalised (ASCII lower case, words of letters and digits) and
its set of word bigrams compared with each template's: 2 |A & B| / (|A| + |B|).
A Dice of t needs sizes within t / (2 - t) of each other, so templates of other
sizes are pruned before any bigram is made.  One pass without a shuffle; the
templates are a constant of the code.  That is what the SQL of op8_licenses asks for;
find_licenses() also slides a window of each template's size over the words and
returns every licence with its span.

Cases: a null or empty text, or one without bigrams, has no hit; a tie goes to
the licence that is first in alphabetical order; a segment that occurs again
counts again in n_hits; repeated rows and null ids are returned each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

THRESHOLD = 0.8
STEP = 512  # pairs of words between two looks at the size bound
#: Public licence notices in their usual short forms, and passages of licences; full_texts() has whole ones.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-short": "Released under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def words_of(raw: bytes) -> list[bytes]:
    keep = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
    return raw.lower().translate(keep).split()


def bigrams(words: list[bytes]) -> set:
    return set(zip(words, words[1:]))


def segments(text: str | None) -> list[bytes]:
    """The whole text, its blocks if there are several, its lines if there are several."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    blocks, lines = raw.split(b"\n\n"), raw.split(b"\n")
    return [raw, *(blocks if len(blocks) > 1 else []), *(lines if len(lines) > 1 else [])]


def scan(text: str | None, templates, threshold: float) -> tuple[int, str | None, float | None]:
    """(segments with a match, best licence, its Dice); templates: (name, bigrams) by name."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    widest = max(len(g) for _, g in templates) * high
    hits, best = 0, (0.0, None)
    for raw in segments(text):
        words = words_of(raw)
        if len(words) < 2:
            continue
        near = [(name, g) for name, g in templates if low * len(g) <= len(words) - 1]  # distinct bigrams are no more than pairs of words
        own: set = set()
        for at in range(0, len(words) - 1, STEP) if near else ():
            own.update(bigrams(words[at : at + STEP + 1]))
            if len(own) > widest:
                break
        if not near or len(own) > widest:
            continue
        top = (0.0, None)
        for name, g in near:
            if low * len(g) <= len(own) <= high * len(g):
                dice = 2 * len(own & g) / (len(own) + len(g))
                if dice >= threshold and dice > top[0]:
                    top = (dice, name)
        if top[1]:
            hits += 1
            if (-top[0], top[1]) < (-best[0], best[1] or "~"):
                best = top
    return hits, best[1], best[0] if hits else None


def notices(text: str | None, templates, threshold: float) -> list[tuple[str, int, int, float]]:
    """(licence, start, end, Dice) of every match in windows of each template's
    size, in code points; of overlapping windows of a template the best stays.
    templates: (name, bigrams, number of words)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    keep = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
    flat = raw.lower().translate(keep)
    words = flat.split()
    pairs = list(zip(words, words[1:]))
    all_of, ends, out = set(pairs), None, []
    for name, grams, size in templates:
        # a Dice of t with i shared of w and g bigrams needs i <= w, so i >= t g / (2 - t)
        if len(all_of & grams) < threshold / (2 - threshold) * len(grams):
            continue
        width = min(size - 1, len(pairs))
        seen: dict = {}
        shared, found = 0, []
        for k, x in enumerate(pairs):
            seen[x] = seen.get(x, 0) + 1
            shared += seen[x] == 1 and x in grams
            if k >= width:
                y = pairs[k - width]
                seen[y] -= 1
                if not seen[y]:
                    del seen[y]
                    shared -= y in grams
            if k >= width - 1:
                dice = 2 * shared / (len(seen) + len(grams))
                if dice >= threshold:
                    found.append((-dice, k - width + 1))
        taken: list[int] = []
        for minus, at in sorted(found):
            near = bisect(taken, at)
            if (near and at - taken[near - 1] <= width) or (near < len(taken) and taken[near] - at <= width):
                continue
            taken.insert(near, at)
            if ends is None:
                ends = [m.span() for m in re.finditer(rb"[^ ]+", flat)]
            start, end = ends[at][0], ends[at + width][1]
            first = len(raw[:start].decode("utf-8", "surrogatepass"))
            out.append((name, first, first + len(raw[start:end].decode("utf-8", "surrogatepass")), -minus))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _notice_batches(templates: dict[str, str], threshold: float):
    def run(batches):
        import pyarrow as pa

        parts = [(name, words_of(t.encode())) for name, t in sorted(templates.items())]
        sets = [(name, bigrams(w), len(w)) for name, w in parts]
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("dice", pa.float64())]))
        for b in batches:
            rows = [[dict(zip(("license", "start", "end", "dice"), x)) for x in notices(t.as_py(), sets, threshold)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "matches"])

    return run


def full_texts() -> dict[str, str]:
    """Licence texts in full, from the files beside this module."""
    return {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, matches) of every row: every licence found in word windows, with its
    span and Dice; TEMPLATES and full_texts() unless others are given."""
    templates = templates or TEMPLATES | full_texts()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _notice_batches(templates, threshold), "doc_id long, matches array<struct<license: string, start: bigint, end: bigint, dice: double>>"
    )


def _scan_batches(templates: dict[str, str], threshold: float):
    def run(batches):
        import pyarrow as pa

        sets = [(name, bigrams(words_of(t.encode()))) for name, t in sorted(templates.items())]
        for b in batches:
            rows = [scan(t.as_py(), sets, threshold) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())],
                names=["doc_id", "n_hits", "license", "dice"],
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_hits, license, dice) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan_batches(templates, threshold), "doc_id long, n_hits long, license string, dice double")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 9))


def op8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


_VALUES = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in TEMPLATES.items())
OP8_SQL = f"""
WITH low(c) AS (SELECT 'abcdefghijklmnopqrstuvwxyz'), d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
seg AS (SELECT rid, 0 AS kind, 1 AS pos, t AS s FROM d
        UNION ALL SELECT rid, 1, unnest(range(1, len(p) + 1)), unnest(p) FROM (SELECT rid, string_split(t, chr(10) || chr(10)) AS p FROM d) WHERE len(p) > 1
        UNION ALL SELECT rid, 2, unnest(range(1, len(p) + 1)), unnest(p) FROM (SELECT rid, string_split(t, chr(10)) AS p FROM d) WHERE len(p) > 1),
sw AS (SELECT rid, kind, pos, regexp_extract_all(translate(s, upper(c), c), '[a-z0-9]+') AS w FROM seg, low),
sg AS (SELECT rid, kind, pos, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM sw WHERE len(w) > 1),
tw(name, w) AS (SELECT v.name, regexp_extract_all(translate(v.t, upper(c), c), '[a-z0-9]+') FROM (VALUES {_VALUES}) v(name, t), low),
tg AS (SELECT name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
m AS (SELECT rid, kind, pos, name, 2.0::DOUBLE * len(list_intersect(sg.g, tg.g)) / (len(sg.g) + len(tg.g)) AS dice FROM sg JOIN tg
      ON len(sg.g) BETWEEN {THRESHOLD / (2 - THRESHOLD)} * len(tg.g) AND {(2 - THRESHOLD) / THRESHOLD} * len(tg.g)),
h AS (SELECT * FROM m WHERE dice >= {THRESHOLD}),
b AS (SELECT rid, count(DISTINCT (kind, pos)) AS n, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice FROM h GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_hits, license, round(b.dice, 9) AS dice FROM d LEFT JOIN b USING (rid)
"""
