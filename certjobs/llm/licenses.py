"""License scan: Dice coefficient over word bigrams against templates, in DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certjobs.llm.common import text_of

#: Least Dice coefficient of a match.
LEAST = 0.8
#: Template text that may be broadcast, spread over the sizes it can match; beyond it the join is shuffled.
BROADCAST_BYTES = 8 << 20
#: What parts blocks: line ends with nothing but signs (blank lines, bare comment marks) between them.
BLOCK_END = r"\n[^A-Za-z0-9]*\n"

#: Short public licence notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NOTICES.items()), "license_id string, text string")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words of the normalised text (lower case; words are runs of a-z and 0-9)."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))


def pivots(texts: list[str], least: float) -> list[str]:
    """Words of which any text that matches a template holds at least one.

    A match shares at least ``least * (1 + least / (2 - least)) / 2`` of a template's bigrams. So, of any larger share of its
    bigrams than the rest, one is in the text; for each template, words are chosen until the bigrams with them are that many, long
    words first.
    """
    share = least * (1 + least / (2 - least)) / 2
    chosen: set[str] = set()
    for text in texts:
        words = re.findall("[a-z0-9]+", text.lower())
        left = set(zip(words, words[1:], strict=False))
        most = len(left) * (1 - share) - 1e-9
        missing = len(left) - sum(1 for b in left if chosen & set(b))
        while left and len(left) - missing <= most:
            open_ = {w: sum(w in b for b in left if not chosen & set(b)) for w in {x for b in left for x in b} - chosen}
            best = max(open_, key=lambda w: (min(len(w), 6), open_[w], w))
            chosen.add(best)
            missing = len(left) - sum(1 for b in left if chosen & set(b))
    return sorted(chosen)


def scan_licenses(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_matches`` (matching pairs of unit and template), ``licenses`` (their distinct
    template ids, sorted, comma-joined) and the best match (``best_license``, ``best_score``; ties by id), null if none.

    A document is compared as a whole, by blocks of lines (a notice wrapped over several lines, also in a comment) and line by
    line; equal units count once. Two sets of bigrams can only reach the
    coefficient ``least`` if the smaller has at least ``least / (2 - least)`` of the larger's size; a template meets only
    units within these bounds. Units without two words match nothing; null texts and templates count as empty; an empty
    table gives no rows, and rows that repeat a key, null included, are judged by all texts of that key.
    """
    ratio = least / (2 - least)
    sized = templates.select("license_id", bigrams(text_of("text")).alias("t")).filter(F.size("t") > 0)
    sized = sized.withColumn("nt", F.size("t")).withColumn(
        "n", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.col("nt") * ratio - 1e-9)).cast("int"), F.floor(F.col("nt") / ratio + 1e-9).cast("int")))
    )
    bytes_ = sized.agg(F.sum(F.octet_length(F.array_join("t", " ")) + 64).alias("b")).first()["b"] or 0
    small = F.broadcast(sized) if bytes_ <= BROADCAST_BYTES else sized
    body, shown = text_of(text), docs
    if bytes_ <= BROADCAST_BYTES:  # texts without any pivot word match nothing and are not taken apart
        words = pivots([r["t"] for r in templates.select(text_of("text").alias("t")).collect()], least)
        shown = docs.filter(reduce(or_, [F.contains(F.lower(body), F.lit(w)) for w in words], F.lit(False)))
    units = shown.select(F.col(key).alias("doc_id"), F.explode(F.array_distinct(F.concat(F.array(body), F.split(body, BLOCK_END, -1), F.split(body, "\n", -1)))).alias("unit"))
    met = units.select("doc_id", bigrams(F.col("unit")).alias("u")).withColumn("n", F.size("u")).join(small, "n")
    dice = (F.lit(2.0) * F.size(F.array_intersect("u", "t"))) / (F.col("n") + F.col("nt"))
    hits = met.select("doc_id", "license_id", dice.alias("score")).filter(F.col("score") >= least)
    per = hits.groupBy("doc_id").agg(
        F.count("*").alias("n_matches"),
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"),
        F.min(F.struct((-F.col("score")).alias("s"), F.col("license_id").alias("id"))).alias("best"),
    )
    joined = docs.select(F.col(key).alias("k")).join(per, F.col("k").eqNullSafe(F.col("doc_id")), "left")
    return joined.select(
        F.col("k").alias("doc_id"), F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"), F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.col("best.id").alias("best_license"), (-F.col("best.s")).alias("best_score"),
    )
