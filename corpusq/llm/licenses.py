"""License scans by diagonal voting, in DataFrame functions only.

Every word k-gram of every text is hashed and joined with the hashed k-grams of a fixed table of licence
notices and whole short licences (some 1,200 rows, so it is broadcast); a hit stays where the k words themselves are
equal. A hit at word i of the text and word j of the notice votes for the diagonal i - j. Votes are summed by
diagonal, neighbouring diagonals are merged (words inserted or left out), and a merged span counts when the words of
the notice that stand in it are a large enough part of the notice. Texts are read and cut into words once.

Defined cases: null or empty text has no words, no places, empty label strings and score 0; null doc_id and
repeated rows give one output row per input row; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.common import lower_ascii, stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wordings of public licence notices, with their labels.
NOTICES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software
        without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons
        to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
        merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source
        code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice
        this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder
        nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided
        by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness
        for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or
        consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on
        any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of
        the possibility of such damage"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
        permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties
        of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss
        of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an
        acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented
        as being the original software 3 this notice may not be removed or altered from any source distribution"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in
        source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http
        www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
        either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the
        implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""),
    ("lgpl", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software
        foundation either version 2 1 of the license or at your option any later version"""),
    ("mpl", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"""),
]

K = 4
#: A span counts if its hits cover so much of the notice; diagonals this far apart are one span.
MIN_COVERAGE, MAX_SHIFT = 0.6, 3


def _words(text):
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def _grams(words: str, k: int) -> str:
    parts = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return f"if(size({words}) < {k}, cast(array() as array<bigint>), transform(sequence(0, size({words}) - {k}), i -> xxhash64({parts})))"


def _starts(words: str) -> str:
    """SQL for the ascending starts of all phrases in an array of words."""
    cases = []
    for phrase in PHRASES:
        each = phrase.split()
        cases.append(f"(i <= size({words}) - {len(each)} and " + " and ".join(f"{words}[i + {j}] = '{x}'" for j, x in enumerate(each)) + ")")
    return f"filter(sequence(0, size({words}) - 1), i -> {' or '.join(cases)})"


def places(docs: DataFrame, notices: list[tuple[str, str]] | None = None, k: int = K) -> DataFrame:
    """One pass over the texts, written once. For each row one line with its doc_id, n_words, p (starts of phrases) and base labels; and one line for each place i of the text
    whose k words stand at place j of a notice of n words. Lines of one row have one number, row."""
    rows = [(i, label, words) for i, (label, words) in enumerate(NOTICES if notices is None else notices)]
    table = docs.sparkSession.createDataFrame(rows, "notice int, label string, words string").select("notice", "label", _words(F.col("words")).alias("nw"))
    table = table.select("notice", "label", F.size("nw").alias("n"), F.posexplode(F.expr(_grams("nw", k))).alias("j", "gram"), "nw")
    table = table.select("notice", "label", "n", "j", F.col("gram").alias("of"), F.slice("nw", F.col("j") + 1, k).alias("exact"))
    a = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _words(F.col("text")).alias("w"))
    # The joined text is only searched; places are looked for where it has a phrase.
    b = a.withColumn("t", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    has = {p: F.col("t").contains(f" {p} ") for p in PHRASES}
    some = F.lit(False)
    for x in has.values():
        some = some | x
    c = b.select(
        "doc_id", "row", "w", F.size("w").cast("long").alias("n_words"),
        F.when(some, F.expr(_starts("w"))).otherwise(F.expr("cast(array() as array<int>)")).alias("p"),
        F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in PHRASES.items()])).alias("base"),
        # The first element, without a gram, carries what the row has to say of itself.
        F.expr(f"concat(array(cast(null as bigint)), {_grams('w', k)})").alias("g"),
    )
    c = c.select("doc_id", "row", "w", "n_words", "p", "base", F.posexplode_outer("g").alias("at", "gram"))
    # Equal hashes propose, equal words decide.
    met = c.join(F.broadcast(table), F.col("gram") == F.col("of"), "left")
    met = met.where(F.when(F.col("at") == 0, True).when(F.col("notice").isNull(), False).otherwise(F.slice("w", F.greatest("at", F.lit(1)), k) == F.col("exact")))
    own = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    return stage(met.select("row", own("doc_id"), own("n_words"), own("p"), own("base"), (F.col("at") - 1).alias("i"), "notice", "label", "n", "j"))


def spans(found: DataFrame, k: int = K, min_coverage: float = MIN_COVERAGE, max_shift: int = MAX_SHIFT) -> DataFrame:
    """row, label, first and last word of the span, coverage: the part of the notice's words that stand in the span, word for word."""
    hits = found.where("notice is not null").select("row", "notice", "label", "n", "i", "j", (F.col("i") - F.col("j")).alias("diagonal"))
    votes = hits.groupBy("row", "notice", "label", "n", "diagonal").agg(F.collect_set("j").alias("js"), F.min("i").alias("i0"), F.max("i").alias("i1"))
    w = Window.partitionBy("row", "notice").orderBy("diagonal")
    marked = votes.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= max_shift, 0).otherwise(1))
    marked = marked.withColumn("span", F.sum("new").over(w))
    merged = marked.groupBy("row", "notice", "label", "n", "span").agg(
        F.flatten(F.collect_set("js")).alias("js"), F.min("i0").alias("first"), (F.max("i1") + (k - 1)).alias("last")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct("js"), lambda j: F.sequence(j, j + (k - 1))))))
    merged = merged.withColumn("coverage", (covered / F.col("n")).cast("double"))
    return merged.where(F.col("coverage") >= min_coverage).select("row", "label", "first", "last", "coverage")


def notice_spans(docs: DataFrame, notices: list[tuple[str, str]] | None = None, **options) -> DataFrame:
    """doc_id, label, first, last, coverage of all spans."""
    found = places(docs, notices)
    return found.where("i = -1").select("row", "doc_id").join(spans(found, **options), "row").drop("row")


def license_scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: the best coverage, at least 0.5 with a base label."""
    found = places(docs, notices)
    more = spans(found).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"))
    out = found.where("i = -1").select("row", "doc_id", "n_words", "p", "base").join(more, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.expr("cast(array() as array<string>)"))))
    n_base = F.size("p").cast("long")
    return out.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.get("p", F.lit(0)).cast("long").alias("first_word"), F.get("p", F.size("p") - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.coalesce("best", F.lit(0.0)), F.when(n_base > 0, 0.5).otherwise(0.0))).alias("score"),
    )
