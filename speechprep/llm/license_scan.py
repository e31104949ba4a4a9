"""License notices in texts: winnowed fingerprints find candidates, a banded alignment measures them.

Templates and texts are words (lower case, without punctuation). Hashes of k words in a row are thinned by
winnowing: of each window of w hashes the smallest is a fingerprint, so any k + w - 1 words that a text shares
with a template share one. k and w follow from a template's length and the threshold: they are so small that words
missing or changed anywhere, as many as the threshold allows, leave a fingerprint. An inverted index gives the
templates and places of a fingerprint. Hits that go forward in text and template are chained, at a price for leaving the
diagonal, and each chain is a candidate. The template is then aligned with the text along the chain: between two hits
the band reaches from one to the other, so words may be missing or put in anywhere, one by one or in a block.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechprep.llm.common import Shared

K, WINDOW, BAND, LEAST = 3, 2, 8, 0.8
#: Words that may lie between two hits of a chain: no more than this, nor than twice the template's length.
GAP = 256
#: What a word off the diagonal costs a chain, of one hit.
SHIFT = 0.02
#: Templates of at most so many words have all hashes of two words as fingerprints.
SHORT = 12
#: The index goes to every executor; more templates than this are refused.
MOST_TEMPLATES = 10_000
TOKEN = re.compile(r"\w+")
NEVER = np.uint64(2**64 - 1)

#: The usual short notices of public licences.
SHORT_NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "MIT-line": "Released under the MIT License.",
    "MIT-line-licensed": "Licensed under the MIT License.",
    "BSD-line": "Licensed under the BSD License.",
    "BSD-style-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC-line": "Licensed under the ISC License.",
    "Zlib-line": "Licensed under the zlib License.",
    "Unlicense-line": "This is free and unencumbered software released into the public domain.",
    "public-domain-line": "This work is dedicated to the public domain.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
    "either express or implied. See the License for the specific language governing permissions and limitations under "
    "the License.",
    "BSL-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse "
    "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MPL-1.1-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the "
    "\"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License "
    "at http://www.mozilla.org/MPL/",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
    "of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, version 2.0.",
    "CC0-1.0-line": "This work is licensed under CC0 1.0 Universal.",
    "CC0-1.0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring "
    "rights to this work.",
    "OFL-1.1-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "WTFPL-line": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and "
    "changing it is allowed as long as the name is changed.",
}
for _name, _words in {
    "GPL-2.0": "General Public License 2", "GPL-3.0": "General Public License 3", "LGPL-2.1": "Lesser General Public License 2.1",
    "LGPL-3.0": "Lesser General Public License 3", "AGPL-3.0": "Affero General Public License 3",
}.items():
    _license, _version = _words.rsplit(" ", 1)
    _publisher = "GNU " + _license + " as published by the Free Software Foundation"
    SHORT_NOTICES |= {
        f"{_name}-line": f"This work is licensed under the GNU {_license}, version {_version}.",
        f"{_name}-notice": f"This program is free software: you can redistribute it and/or modify it under the terms of the "
        f"{_publisher}, either version {_version} of the License, or (at your option) any later version.",
        f"{_name}-only-notice": f"This program is free software: you can redistribute it and/or modify it under the terms of "
        f"the {_publisher}, version {_version}.",
    }
for _kind, _long in {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}.items():
    for _version, _port in (("3.0", "Unported"), ("4.0", "International")):
        _long_line = f"This work is licensed under a Creative Commons {_long} {_version} {_port} License."
        _short_line = f"Licensed under CC {_kind} {_version}."
        # These two names were here before and stay with their lines.
        _names = ("-line", "-short") if _kind == "BY" else ("-long", "-line")
        SHORT_NOTICES |= {f"CC-{_kind}-{_version}{_names[0]}": _long_line, f"CC-{_kind}-{_version}{_names[1]}": _short_line}

#: Whole licences, by name of file, and the short notices.
NOTICES = SHORT_NOTICES | {
    path.stem: path.read_text(encoding="utf-8") for path in sorted((Path(__file__).parent / "licences").glob("*.txt"))
}


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "license string, text string")


def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def winnowed(ids: np.ndarray, width: int = K, window: int = WINDOW) -> list[tuple[int, int]]:
    """(place, hash) of the fingerprints of a row of word numbers; 0 is a word that no template has.

    Hashes with such a word rank last and are never chosen, which changes nothing inside shared words.
    """
    n = len(ids) - width + 1
    if n < 1:
        return []
    known = np.ones(n, bool)
    hashes = np.zeros(n, np.uint64)
    for k in range(width):
        part = ids[k : k + n]
        known &= part > 0
        hashes = (hashes ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    if not known.any():
        return []
    hashes[~known] = NEVER
    if n < window:
        chosen = {int(hashes.argmin())}
    else:
        near = np.flatnonzero(known)  # only windows with something to choose
        starts = np.unique(np.clip(np.concatenate([near - j for j in range(window)]), 0, n - window))
        shifted = np.stack([hashes[starts + j] for j in range(window)][::-1])
        chosen = set((starts + window - 1 - shifted.argmin(axis=0)).tolist())  # the last of equal ones
    return [(i, int(hashes[i])) for i in sorted(chosen) if hashes[i] != NEVER]


class Index:
    """Word numbers, templates as word numbers, and the inverted index of fingerprints by their kind."""

    def __init__(self, rows: list[tuple[str, str]], least: float = LEAST):
        self.number: dict[str, int] = {}
        self.names = [name for name, _ in rows]
        self.templates, self.gaps, self.needed = [], [], []
        self.places = defaultdict(lambda: defaultdict(list))
        for t, (_, text) in enumerate(rows):
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], np.int64)
            self.templates.append(ids)
            self.gaps.append(min(GAP, 2 * len(ids) + BAND))
            self.needed.append(needed(len(ids), least))
            kind = thinning(len(ids), least)
            for place, mark in winnowed(ids, *kind):
                self.places[kind][mark].append((t, place))

    def ids(self, found: list[str]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))

    def candidates(self, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(template, chain of hits as rows of place and text place), as many as have the fingerprints needed."""
        hits = defaultdict(list)
        for kind, places in self.places.items():
            for at, mark in winnowed(ids, *kind):
                for t, place in places.get(mark, ()):
                    hits[t].append((at, place))
        out = []
        for t in sorted(hits):
            if len({place for _, place in hits[t]}) >= self.needed[t]:
                found = np.array(sorted(hits[t]))
                least = max(1, self.needed[t] // 2)
                out += [(t, c[:, ::-1]) for c in chains(found, self.gaps[t]) if len(c) >= least]
        return out


def chains(hits: np.ndarray, gap: int) -> Iterator[np.ndarray]:
    """Heaviest chains of hits (text place, template place), which are sorted; each hit is in one chain.

    A chain goes forward in both, by ``gap`` words of the text at most. A hit counts 1, each word by which two hits in a
    row are off the diagonal costs SHIFT.
    """
    at, place = hits[:, 0], hits[:, 1]
    first = np.searchsorted(at, at - gap)
    score, before = np.ones(len(hits)), np.full(len(hits), -1)
    for i in range(len(hits)):
        near = slice(first[i], i)
        step, down = at[i] - at[near], place[i] - place[near]
        good = score[near] - SHIFT * np.abs(step - down)
        good[(step <= 0) | (down <= 0)] = 0
        if len(good) and (best := good.argmax()) >= 0 and good[best] > 0:
            score[i], before[i] = 1 + good[best], first[i] + best
    used = np.zeros(len(hits), bool)
    for end in np.argsort(-score, kind="stable"):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(end)
            end = before[end]
        if chain:
            yield hits[chain[::-1]]


def _missing(n: int, least: float) -> int:
    """How many of n words may be missing or changed."""
    return n - int(np.ceil(n * least - 1e-9))


def thinning(n: int, least: float = LEAST) -> tuple[int, int]:
    """Words in a hash and hashes in a window for a template of n words.

    With e words missing or changed, (n - e) / (e + 1) words in a row are left somewhere, and a fingerprint is sure to
    be shared if that is k + w - 1. Short templates take all hashes of two words (of one, if no more are left).
    """
    e = _missing(n, least)
    run = -(-(n - e) // (e + 1))
    if n <= SHORT or run < K:
        return min(2, max(1, run)), 1
    return K, max(1, min(WINDOW, run - K + 1))


def needed(n: int, least: float = LEAST) -> int:
    """A lower bound on the fingerprints of a template of n words that a text at the threshold shares.

    Of n - 3 windows of four words each missing word spoils four at most, a fingerprint serves two windows; half of
    that again is left for inserted words. Below it a text is not aligned with a long template.
    """
    return max(1, (n - 3 - 4 * _missing(n, least)) // 4) if thinning(n, least) == (K, WINDOW) else 1


def align(template: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Matched places (template, text) of the best alignment inside a band.

    With i words of the template behind it, it is between ``low[i]`` and ``high[i]`` words into the text; neither
    may fall. A match counts 1, a skipped word on either side costs a quarter; text before and after is free.
    """
    low, high = np.clip(low, 0, len(ids)).tolist(), np.clip(high, 0, len(ids)).tolist()
    score = np.zeros(high[0] - low[0] + 1)
    steps = [np.zeros(len(score), np.int8)]
    for i in range(1, len(template) + 1):
        start, width, shift = low[i], high[i] - low[i] + 1, low[i] - low[i - 1]
        # What the row before has at the same words of the text, and one word earlier.
        same = np.full(width + 1, -np.inf)
        there = score[max(0, shift - 1) :][: width + 1 - (shift == 0)]
        same[1 if shift == 0 else 0 :][: len(there)] = there
        words = ids[max(0, start - 1) : high[i]]
        match = same[:-1].copy()
        equal = words == template[i - 1]
        if start == 0:
            match[0] = -np.inf
            match[1:][~equal] = -np.inf
        else:
            match[~equal] = -np.inf
        match += 1.0
        skip = same[1:] - 0.25
        row = np.maximum(match, skip)
        across = 0.25 * np.arange(width)
        skipped = np.maximum.accumulate(row + across) - across  # words of the text
        steps.append(np.where(skipped > row, 3, np.where(match >= skip, 1, 2)).astype(np.int8))
        score = skipped
    i, at = len(template), low[-1] + int(score.argmax())
    places = []
    while i > 0:
        if not low[i] <= at <= high[i]:
            break
        how = steps[i][at - low[i]]
        if how == 1:
            places.append((i - 1, at - 1))
            i, at = i - 1, at - 1
        elif how == 2:
            i -= 1
        else:
            at -= 1
    return places[::-1]


def band_along(chain: np.ndarray, n: int, gap: int, band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """The band of ``align`` along a chain (place, text place) in a template of n words."""
    place, at = chain[:, 0], chain[:, 1]
    rows = np.arange(n + 1)
    after = np.searchsorted(place, rows)  # the first hit that is not before the row
    # Before the first hit and behind the last one the text may have more words or fewer.
    head, tail = int(place[0]), n - int(place[-1])
    starts = np.concatenate([[at[0] - head - min(gap, head // 2)], at]) - band
    ends = np.concatenate([at, [at[-1] + tail + min(gap, tail // 2)]]) + band
    return starts[after], ends[after]


def shared_words(template: np.ndarray, near: np.ndarray) -> int:
    """An upper bound on what ``align`` can match: words in common, in whatever order."""
    there, n = np.unique(near, return_counts=True)
    wanted, most = np.unique(template, return_counts=True)
    _, at, of = np.intersect1d(there, wanted, assume_unique=True, return_indices=True)
    return int(np.minimum(n[at], most[of]).sum())


def outermost(kept: list[tuple[int, float, list[int]]]) -> list[tuple[int, float, list[int]]]:
    """Without matches that are part of a fuller one: a tenth of their words at most is not in it.

    So a licence is told from those that share its wording (the BSD clauses, versions of the GPL, kinds of CC BY).
    """
    held = [(coverage, len(places), -t, set(places)) for t, coverage, places in kept]
    return [
        match for match, own in zip(kept, held)
        if not any(x[:3] > own[:3] and 10 * len(own[3] - x[3]) <= len(own[3]) for x in held)
    ]


def scan(text: str, index: Index, least: float = LEAST) -> list[dict]:
    """Matches of a text: license, coverage, matched words, start, end and spans in code points, by place."""
    found = words(text)
    ids = index.ids(found)
    hits = index.candidates(ids) if ids.any() else []
    if not hits:
        return []
    matches = []
    for t, chain in hits:
        template = index.templates[t]
        low, high = band_along(chain, len(template), index.gaps[t])
        if shared_words(template, ids[max(0, low[0]) : high[-1]]) < least * len(template):
            continue
        places = [at for _, at in align(template, ids, low, high)]
        if places and len(places) >= least * len(template):
            matches.append((t, len(places) / len(template), places))
    # Candidates of one template that found the same words: the fullest stays.
    matches.sort(key=lambda m: (m[0], -m[1], m[2][0]))
    kept, used = [], set()
    for t, coverage, places in matches:
        if not any((t, p) in used for p in places):
            used |= {(t, p) for p in places}
            kept.append((t, coverage, places))
    if not kept:
        return []
    kept = outermost(kept)
    lowered = text.lower()
    bounds = [m.span() for m in TOKEN.finditer(text if len(lowered) == len(text) else lowered)]
    out = []
    for t, coverage, places in sorted(kept, key=lambda m: (m[2][0], m[0])):
        runs = np.split(np.array(places), np.flatnonzero(np.diff(places) > 1) + 1)
        spans = [{"start": bounds[r[0]][0], "end": bounds[r[-1]][1]} for r in runs]
        out.append({
            "license": index.names[t], "coverage": coverage, "n_matched": len(places),
            "start": spans[0]["start"], "end": spans[-1]["end"], "spans": spans,
        })
    return out


SCHEMA = (
    "doc_id long, license string, coverage double, n_matched long, start long, end long, "
    "spans array<struct<start: long, end: long>>"
)


def license_scan(
    df: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST
) -> DataFrame:
    """One row for each notice found: doc_id, license, coverage, n_matched, start, end, spans.

    ``templates`` has (license, text), at most MOST_TEMPLATES rows; null ones are left out, and templates
    without words are never found. A template is found where at least ``least`` of its words align, with other words
    between them or missing, a block of GAP words in one place at most (twice the template's words, if they are fewer); one
    text may hold many. Of matches of the same words only the fullest is given (see ``outermost``), so a notice inside
    a whole licence counts as part of it. Coverage is of the whole template. Offsets count code points of the text (of
    its lower-case form, should that have another length). Null and empty texts hold none. Repeated rows are
    each reported. Whole texts are read, in their tasks; nothing is shuffled.
    """
    rows = templates.dropna().orderBy("license", "text").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    shared = Shared(df.sparkSession, [(r.license, r.text) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.made("license_indexes", lambda rows: Index(rows, least))
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                out += [{"doc_id": doc_id.as_py()} | m for m in scan(text.as_py() or "", index, least)]
            yield pa.RecordBatch.from_pylist(out, SCHEMA_ARROW)

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, SCHEMA)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
SCHEMA_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()),
    ("start", pa.int64()), ("end", pa.int64()), ("spans", pa.list_(SPAN)),
])
