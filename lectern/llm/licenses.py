"""License scans by diagonal voting, in DataFrame functions only.

Every three words in a row of a text are hashed and joined with the hashes of the templates' positions (a table of
fixed size, so it is broadcast); the words are compared in full there. A match at word p with position q of a template
votes for the diagonal p - q, where the template would begin. Diagonals next to one another, as words that were put in
or left out give, are merged, and a span is verified: of its votes those count that go on in the template as they go on
in the text, and the words that they cover must be SHARE or more of the template's and of the span's. Phrases and
templates of under LOOSE words must stand word by word, since one word makes another license of them. A span inside a
larger one that covers more words is part of that one's wording and gives no label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import split_words, table, words

GRAM = 3
#: Diagonals this far apart belong to one span; the share of a template's and of a span's words that must agree; the
#: words from which on a template may differ at all.
DRIFT, SHARE, LOOSE = 3, 0.8, 16
#: The phrases whose places are counted, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Wordings of well-known notices, and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("creative commons attribution noderivatives 4 0 international license", "cc-by-nd"),
    ("creative commons attribution noncommercial sharealike 4 0 international license", "cc-by-nc-sa"),
    ("creative commons attribution noncommercial noderivatives 4 0 international license", "cc-by-nc-nd"),
    ("creative commons attribution 3 0 unported license", "cc-by"),
    ("creative commons attribution sharealike 3 0 unported license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
#: Whole texts of short licenses and file notices.
WHOLE = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND "
        "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "bsd",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
        "apache-2",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
        "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "unlicense",
    ),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution.",
        "zlib",
    ),
)


def _templates() -> list[tuple[int, list[str], bool, str]]:
    """(number, words, whether it is a phrase, label)."""
    every = [(t, True, label) for t, label in PHRASES] + [(t, False, label) for t, label in (*TEMPLATES, *WHOLE)]
    return [(k, [w.decode() for w in words(t)], base, label) for k, (t, base, label) in enumerate(every)]


def _template_rows(spark: SparkSession) -> DataFrame:
    """template, label, base, need (words), q, own (the gram's words), gram: one row for each position."""
    rows = [(k, label, base, len(ws), q, ws[q : q + GRAM]) for k, ws, base, label in _templates() for q in range(len(ws) - GRAM + 1)]
    df = spark.createDataFrame(rows, "template int, label string, base boolean, need int, q int, own array<string>")
    return df.withColumn("gram", F.xxhash64(*[F.get("own", F.lit(k)) for k in range(GRAM)]))


def _verified(votes: Column) -> Column:
    """Of votes (p, q) in order of p those that go on in the template too: how many words they cover, and the first and
    the end of those words in the text. A vote covers GRAM words but those that the one before it has covered."""
    start = F.struct(F.lit(0).alias("covered"), F.lit(-1).alias("first"), F.lit(-1).alias("p"), F.lit(-1).alias("q"))

    def follow(acc: Column, x: Column) -> Column:
        new = F.least(F.lit(GRAM), x["q"] - acc["q"], x["p"] - acc["p"])
        first = acc["q"] < 0
        went = F.struct((acc["covered"] + F.when(first, GRAM).otherwise(new)).alias("covered"), F.when(first, x["p"]).otherwise(acc["first"]).alias("first"), x["p"].alias("p"), x["q"].alias("q"))
        return F.when(first | ((x["q"] > acc["q"]) & (x["p"] > acc["p"])), went).otherwise(acc)

    return F.aggregate(votes, start, follow, lambda acc: F.struct(acc["covered"].alias("covered"), acc["first"].alias("first"), (acc["p"] + GRAM).alias("last")))


def spans(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, n_words and, for each span found, label, base, first (its start in words), share; a document
    without spans has one row with nulls there. row_id tells repeated ids apart. Needs doc_id and text.

    Grams that no template has are left in their row by a look at a set of fixed size, so what is joined and shuffled
    are votes alone; of a span's votes, a list as long as its wording meets in one row."""
    docs = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    docs = split_words(docs, "text", "ws")
    ws, size = F.col("ws"), F.size("ws")
    templates = _template_rows(docs.sparkSession)
    known = [r.gram for r in templates.select("gram").distinct().collect()]  # a few hundred
    gram = lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(GRAM)])
    places = F.filter(F.sequence(F.lit(0), size - GRAM), lambda i: gram(i).isin(known))
    hits = F.transform(places, lambda i: F.struct(i.alias("p"), F.slice(ws, i + 1, GRAM).alias("own"), gram(i).alias("gram")))
    docs = docs.select("row_id", "doc_id", size.cast("long").alias("n_words"), F.when(size >= GRAM, hits).alias("hits"))
    keys = ["row_id", "doc_id", "n_words"]
    each = docs.select(*keys, F.explode_outer("hits").alias("g")).select(*keys, "g.*")
    votes = each.join(F.broadcast(templates), ["gram", "own"], "left").select(*keys, "template", "label", "base", "need", "p", "q")
    votes = votes.repartition("row_id").withColumn("diagonal", F.col("p") - F.col("q"))  # all that follows is by row
    # what must stand word by word does not drift
    strict = F.col("need") < LOOSE
    line = Window.partitionBy("row_id", "template").orderBy("diagonal", "p")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > F.when(strict, 0).otherwise(DRIFT)
    votes = votes.withColumn("group", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(line))
    # a template that begins anew is another span
    line = Window.partitionBy("row_id", "template", "group").orderBy("p", "q")
    anew = F.col("q") <= F.lag("q").over(line)
    votes = votes.withColumn("part", F.sum(F.coalesce(anew.cast("int"), F.lit(0))).over(line))
    merged = votes.groupBy(*keys, "template", "label", "base", "need", "group", "part").agg(
        F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "q")))).alias("votes")
    )
    found = merged.withColumn("v", _verified(F.col("votes"))).select(*keys, "template", "label", "base", "need", "v.*")
    share = F.col("covered") / F.col("need")
    stands = F.when(strict, F.col("covered") == F.col("need")).otherwise((share >= SHARE) & (F.col("covered") >= SHARE * (F.col("last") - F.col("first"))))
    found = found.withColumn("stands", F.col("template").isNotNull() & stands)
    # inside: a span before it in this order ends no earlier and covers more
    order = Window.partitionBy("row_id").orderBy(F.desc("stands"), "first", F.desc("last"), F.desc("covered"), "template").rowsBetween(Window.unboundedPreceding, -1)
    outer = F.max(F.struct("last", "covered")).over(order)
    inside = ~F.col("base") & (outer["last"] >= F.col("last")) & (outer["covered"] > F.col("covered"))
    keep = lambda c: F.when(F.col("stands") & ~F.coalesce(inside, F.lit(False)), c)
    return found.select(*keys, keep(F.col("label")).alias("label"), keep(F.col("base")).alias("base"), keep(F.col("first").cast("long")).alias("first"), keep(share).alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the phrases' places, first_word and last_word are the smallest and largest start of one (words from
    0; else null); labels also has those of verified templates; score is the greatest share of a template's words that
    stands, 0 for none. Null, empty and short texts have none, nor have tables without rows; rows with equal ids are
    scanned each by itself; a passage that many documents share is matched in each; a text of any length is scanned
    whole, and what is kept of it is its matches. Other columns are left out. Texts never leave their partition; what is
    shuffled is one row a match, and one a document.
    """
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans(docs)
        .groupBy("row_id", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(F.col("label")).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
        .drop("row_id")
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def brute(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    """n_words and (start, label) of every place of a phrase; for tests."""
    ws = words(text)
    found = []
    for phrase, label in PHRASES:
        own = words(phrase)
        found += [(i, label) for i in range(len(ws) - len(own) + 1) if ws[i : i + len(own)] == own]
    return len(ws), sorted(found)


def brute_spans(text: str | None) -> list[tuple[str, bool, int, float]]:
    """(label, base, first, share) of every span by looking at all pairs of places, and all pairs of spans; for tests."""
    ws = [w.decode() for w in words(text)]
    found = []
    for _, own, base, label in _templates():
        votes = sorted((p - q, p, q) for p in range(len(ws) - GRAM + 1) for q in range(len(own) - GRAM + 1) if ws[p : p + GRAM] == own[q : q + GRAM])
        loose = len(own) >= LOOSE
        groups: list[list] = []
        for d, p, q in votes:
            if not groups or d - groups[-1][-1][0] > (DRIFT if loose else 0):
                groups.append([])
            groups[-1].append((d, p, q))
        for group in groups:
            parts: list[list] = []
            for p, q in sorted((p, q) for _, p, q in group):
                if not parts or q <= parts[-1][-1][1]:
                    parts.append([])
                parts[-1].append((p, q))
            for part in parts:
                chain: list[tuple[int, int]] = []
                for p, q in part:
                    if not chain or (q > chain[-1][1] and p > chain[-1][0]):
                        chain.append((p, q))
                covered = len({q + k for _, q in chain for k in range(GRAM)} if not loose else ()) or GRAM + sum(min(GRAM, b - d, a - c) for (c, d), (a, b) in zip(chain, chain[1:]))
                first, last = chain[0][0], chain[-1][0] + GRAM
                if covered == len(own) if not loose else covered >= SHARE * len(own) and covered >= SHARE * (last - first):
                    found.append((first, last, covered, base, label, covered / len(own)))
    out = []
    for s in found:
        reach = max((o for o in found if (o[0], -o[1], -o[2]) < (s[0], -s[1], -s[2])), key=lambda o: (o[1], o[2]), default=None)
        if s[3] or reach is None or reach[1] < s[1] or reach[2] <= s[2]:
            out.append((s[4], s[3], s[0], s[5]))
    return out
