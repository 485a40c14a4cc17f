"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

For a template of n words, windows of n + n/4 words start every n/4 words, so each occurrence lies whole
in one of them. A window that holds a share `containment` of the template's shingles has a known least
Jaccard similarity with it; the number of bands is set so that the two share a band with a probability of
at least 1 - `miss`. Retrieved pairs are verified by exact containment. Windows without any template
shingle can share no band and are passed over unhashed.

Edge cases: a null text is an empty one and has no license; texts are read whole; templates of fewer
words than a shingle are one shingle; of templates that match the same words the one with the most
matched shingles is reported (then the first by name); repeated rows get repeated results.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm.common import Spans, map_rows, schema

#: Texts and notices of public licenses by SPDX id (fixed values).
TEMPLATES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
)
_WORD = re.compile(r"[^\W_]+")
Shingle = tuple[str, ...]


def shingles(words: list[str], size: int) -> list[Shingle]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def least_similarity(containment: float, slack: float = 0.25) -> float:
    """The Jaccard similarity of a template and a window of 1 + slack times its length that holds this share of it."""
    return containment / (1 + (1 + slack) - containment)


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """So many bands that sets of this similarity share one with a probability of 1 - miss."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


class Matcher:
    def __init__(self, templates=TEMPLATES, size: int = 3, containment: float = 0.8, rows: int = 2, miss: float = 1e-4, seed: int = 11) -> None:
        self.size, self.containment, self.rows = size, containment, rows
        self.bands = bands_for(least_similarity(containment), rows, miss)
        rng = np.random.default_rng(seed)
        self.mix = rng.integers(1, 1 << 63, (self.bands * rows, 2), np.uint64) | np.uint64(1)
        self.names, self.sets, self.lengths = [], [], []
        self.known: dict[Shingle, np.uint64] = {}
        self.index: dict[tuple[int, int, bytes], list[int]] = defaultdict(list)
        for name, text in templates:
            words = [w.lower() for w in _WORD.findall(text)]
            own = set(shingles(words, size))
            self.names.append(name)
            self.sets.append(own)
            self.lengths.append(len(words))
            for s in own:
                self.known.setdefault(s, np.uint64(xxhash.xxh64_intdigest(" ".join(s))))
            for band, key in enumerate(self.signature(own)):
                self.index[len(words), band, key].append(len(self.names) - 1)
        self.windows = sorted(set(self.lengths))

    def signature(self, own: set[Shingle]) -> list[bytes]:
        h = np.array([self.known[s] if s in self.known else np.uint64(xxhash.xxh64_intdigest(" ".join(s))) for s in own], np.uint64)
        x = (h[None, :] ^ self.mix[:, :1]) * self.mix[:, 1:]  # odd multipliers: a bijection each
        x ^= x >> np.uint64(29)
        least = (x * self.mix[:, :1]).min(1)
        return [least[n : n + self.rows].tobytes() for n in range(0, len(least), self.rows)]

    def find(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """License, start, end (code points) and containment of each match, by start."""
        if not text:
            return []
        low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = _WORD.findall(low)
        known, size = self.known, self.size
        columns = [words[k:] for k in range(size)]
        at = [i for i, s in enumerate(zip(*columns, strict=False)) if s in known]
        if not at and not (len(words) < size and tuple(words) in known):
            return []
        found: list[tuple[int, int, int, int]] = []  # shingles, template, first and last word
        for n in self.windows:
            stride = max(1, n // 4)
            starts = sorted({b for i in at for b in range(max(0, (i + size - n - stride) // stride * stride), i + 1, stride)} | ({0} if not at else set()))
            for b in starts:
                window = words[b : b + n + stride]
                own = set(shingles(window, size))
                if own.isdisjoint(known):
                    continue
                near = {t for band, key in enumerate(self.signature(own)) for t in self.index.get((n, band, key), ())}
                for t in near:
                    common = self.sets[t] & own
                    if len(common) >= self.containment * len(self.sets[t]):
                        places = [k for k, s in enumerate(shingles(window, size)) if s in common]
                        found.append((len(common), t, b + places[0], min(b + places[-1] + size, len(words)) - 1))
        spans = [(m.start(), m.end()) for m in _WORD.finditer(low)] if found else []
        out, taken = [], Spans([])
        for common, t, a, b in sorted(found, key=lambda x: (-x[0], self.names[x[1]], x[2], x[3])):
            if not taken.overlap(a, b + 1):
                taken.add(a, b + 1)
                out.append((self.names[t], spans[a][0], spans[b][1], common / len(self.sets[t])))
        return sorted(out, key=lambda x: (x[1], x[0]))


@lru_cache(maxsize=2)
def default_matcher(containment: float = 0.8) -> Matcher:
    return Matcher(containment=containment)


RESULT = schema(doc_id=T.LongType(), found=T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("containment", T.DoubleType())])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", matcher: Matcher | None = None) -> DataFrame:
    """doc_id and the license matches of each row."""
    matcher = matcher or default_matcher()

    def rows(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "found": [[{"license": n, "start": s, "end": e, "containment": c} for n, s, e, c in matcher.find(t)] for t in b["text"]]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), rows, RESULT)


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """License matches of every document, by scan()."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",").alias("spans"),
    )
