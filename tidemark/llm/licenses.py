"""License scanning by diagonal voting of word k-grams (DataFrame operations only)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .common import literal_rows, table

#: Words, after lower-casing: runs of digits, letters and anything that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases, of which each place is reported.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Public license texts by label, their telling sentences first, then whole notices.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "CC BY 4.0"),
    ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by-nc", "CC BY-NC 4.0"),
    ("cc0", "Creative Commons CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
      files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
      merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
      to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
      or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
      INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
      SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
      OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
      following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
      the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
      the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY
      THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
      WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
      CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
      TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
      THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
      USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
      derived from this software without specific prior written permission."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
      License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
      agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
      ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
      License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
      published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
      distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
      FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
      General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
      License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
      License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
      with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
      provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
      AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
      EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
      LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
      WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
)
K = 2
#: Grams of nothing but these words vote for no template: they are everywhere and say nothing.
COMMON = frozenset("a an and are any as at be by for from in is it may not of on or the this to with you".split())
#: A template of fewer words is only found word for word: one word more or less would make another license of it.
SHORT = 12
#: Votes at most this far from a diagonal count with it (words put in or left out), and the part of a template's
#: grams that must stand there.
BAND, COVERAGE = 3, 0.8
#: Grams of a template whose votes share a word of bits.
BITS = 62
#: Templates are a parameter, not data; the index that is broadcast has a row per gram and can't outgrow this.
MOST_GRAMS = 100_000


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _index(spark: SparkSession, templates: Sequence[tuple[str, str, bool]]) -> tuple[DataFrame, DataFrame]:
    """(gram, a, b, template, at, part, mask): hashes, words and positions of the templates' grams, and (template, label, base, exact, grams)."""
    grams, heads = [], []
    for n, (label, text, base) in enumerate(templates):
        words = template_words(text)
        exact = base or len(words) < SHORT
        kept = [(i, words[i : i + K]) for i in range(len(words) - K + 1) if exact or not COMMON.issuperset(words[i : i + K])]
        if not kept:
            raise ValueError(f"template {n} needs two words or more: {text!r}")
        grams += [(*gram, n, i, nth // BITS, 1 << nth % BITS) for nth, (i, gram) in enumerate(kept)]
        heads.append((n, label, base, exact, len(kept)))
    if len(grams) > MOST_GRAMS:
        raise ValueError("too many templates to send to every executor")
    index = literal_rows(spark, grams, "a string, b string, template int, at int, part int, mask long")
    return index.select(F.xxhash64("a", "b").alias("gram"), *index.columns), literal_rows(spark, heads, "template int, label string, base boolean, exact boolean, grams int")


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Every rolling gram of two words is hashed and joined to the templates' gram positions, and the words of each pair that
    meets are compared, so that what votes is words, not hashes. Document position less template position is the diagonal,
    where the template would begin. Votes are a bit per gram, so a gram that repeats votes once. A phrase or short template
    stands where a diagonal has all its votes. For longer ones, diagonals are merged with their neighbours within BAND; a
    merged one that none within BAND exceeds is a span, as long as its template and BAND words on either side, and has the
    label if it holds COVERAGE of the template's grams. score is the largest coverage (1 for a phrase).

    A null text is empty; texts of fewer than two words have no grams; texts may be of any length; null keys and repeated
    rows are kept. Rows alike in key and text are summed up together and put out as often as they came. Each text is read
    once: a mark in front of its grams, which joins like them, carries its word count. Only votes are shuffled, summed up by
    diagonal before. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    index, heads = _index(spark, [(label, phrase, True) for label, phrase in phrases] + [(label, notice, False) for label, notice in notices])
    # The mark's hash comes from an array, which no gram is; votes for template -1 count the rows.
    mark = F.xxhash64(F.array(F.lit("start"), F.lit("of"), F.lit("text")))
    none = F.lit("")
    first = spark.range(1).select(mark.alias("gram"), none.alias("a"), none.alias("b"), F.lit(-1).alias("template"), F.lit(0).alias("at"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("mask"))
    index = index.unionByName(first)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # lower() changes more than A-Z, but of words in ASCII letters it makes the same, and phrases and notices have no others.
    words = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("text_hash"), F.regexp_extract_all(F.lower(body), F.lit(WORD), F.lit(0)).alias("words"))
    # The list's own tail beside it: a lambda that looked into the list again could be planned to build it for each word.
    grams = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.struct(F.xxhash64(a, b).alias("gram"), a.alias("a"), b.alias("b")))
    marked = words.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.concat(F.array(F.struct(mark.alias("gram"), none.alias("a"), none.alias("b"))), grams).alias("grams"))
    # The outer form: for the inner one the planner would test the lists for length first, building them once more.
    read = marked.select("doc_id", "text_hash", "n_words", F.posexplode_outer("grams").alias("position", "said"))
    meet = (read["said.gram"] == index["gram"]) & (read["said.a"] == index["a"]) & (read["said.b"] == index["b"])
    votes = read.join(F.broadcast(index), meet)
    votes = votes.groupBy("doc_id", "text_hash", "template", (F.col("position") - 1 - F.col("at")).alias("diagonal"), "part").agg(F.bit_or("mask").alias("mask"), F.max("n_words").alias("n_words"), F.count("*").alias("n"))
    by_template = ["doc_id", "text_hash", "template"]
    along = Window.partitionBy(*by_template).orderBy("diagonal")

    def near(low: int, high: int) -> WindowSpec:
        return along.rangeBetween(low, high)

    here = votes.join(F.broadcast(heads), "template", "left")
    here = here.withColumn("band", F.sum(F.bit_count("mask")).over(near(-BAND, BAND)))
    strongest = (F.col("band") == F.max("band").over(near(-BAND, BAND))) & (F.coalesce(F.max("band").over(near(-BAND, -1)), F.lit(0)) < F.col("band"))
    enough = F.col("band") >= COVERAGE * F.col("grams")
    here = here.withColumn("anchor", ~F.col("exact") & strongest & enough)
    # Anchors are more than BAND apart, so a diagonal belongs to one on either side at most.
    at = F.when(F.col("anchor"), F.col("diagonal"))
    here = here.withColumns({"below": F.max(at).over(near(-BAND, 0)), "above": F.min(at).over(near(0, BAND))})
    own = F.array_distinct(F.array("below", "above"))
    starts = F.when(F.coalesce("exact", F.lit(True)), F.array("diagonal")).otherwise(F.filter(own, lambda d: d.isNotNull()))
    spans = here.withColumn("start", F.explode(starts)).groupBy(*by_template, "start", "part").agg(
        F.bit_or("mask").alias("mask"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in ("n_words", "label", "base", "exact", "grams")]
    )
    spans = spans.groupBy(*by_template, "start").agg(F.sum(F.bit_count("mask")).alias("held"), *[F.max(c).alias(c) for c in ("n", "n_words", "label", "base", "exact", "grams")])
    whole = F.col("held") == F.col("grams")
    coverage = F.when(F.col("exact"), whole.cast("double")).otherwise(F.col("held") / F.col("grams"))
    place = F.when(F.col("base") & whole, F.col("start"))
    label = F.when(F.coalesce(coverage, F.lit(0.0)) >= COVERAGE, F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(F.col("template") == -1, F.col("n"))).alias("n"), F.max("n_words").cast("long").alias("n_words"), F.count(place).cast("long").alias("n_base"),
        F.min(place).cast("long").alias("first_word"), F.max(place).cast("long").alias("last_word"),
        joined(F.when(place.isNotNull(), F.col("label"))).alias("base_labels"), joined(label).alias("labels"), F.coalesce(F.max(coverage), F.lit(0.0)).alias("score"),
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("copy", "n", "text_hash")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
