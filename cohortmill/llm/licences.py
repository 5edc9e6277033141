"""Licence scans with DataFrame functions and Spark's own learners: a paragraph classifier, calibrated, and confirmed by templates."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.llm.staging import stage

#: Openings, key sentences and body paragraphs of the licences, as their stewards publish them.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released into the public domain under CC0 1.0 Universal."],
    "gpl": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "lgpl": ["You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright (c) the author. All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
#: What people call the licences, and how a notice names one.
NAMES: dict[str, list[str]] = {
    "agpl": ["AGPL", "AGPLv3", "AGPL-3.0", "GNU AGPL v3"],
    "apache": ["Apache 2.0", "Apache-2.0", "Apache License", "Apache License 2.0", "ASL 2.0"],
    "bsd": ["BSD", "BSD 3-Clause", "BSD-3-Clause", "BSD 2-Clause", "BSD License", "New BSD"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "CC BY 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0"],
    "cc0": ["CC0", "CC0 1.0", "CC0-1.0"],
    "gpl": ["GPL", "GPL v2", "GPL v3", "GPLv2", "GPLv3", "GPL-3.0", "GNU GPL"],
    "lgpl": ["LGPL", "LGPL v2.1", "LGPLv3", "LGPL-2.1", "GNU LGPL"],
    "mit": ["MIT", "MIT License", "MIT Licence", "Expat"],
    "mpl": ["MPL", "MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0"],
    "unlicense": ["Unlicense", "the Unlicense"],
}
OTHER_NAMES = ["Eclipse Public License 2.0", "EPL-2.0", "Artistic License 2.0", "European Union Public Licence", "EUPL", "Boost Software License", "zlib license", "WTFPL", "Microsoft Reciprocal License", "Server Side Public License", "SSPL", "ISC License", "Zope Public License", "Python Software Foundation License", "Open Software License 3.0", "Academic Free License", "Ruby License", "PostgreSQL License"]
FORMS = ["Released under {}.", "Distributed under the {}.", "Available under the {} terms", "Licensed under the {} license.", "License: {}", "This file is {} or later.", "This code is {} licensed.", "Dual {}", "Unter der Lizenz {}", "Dieses Programm steht unter der Lizenz {}", "Sous licence {}", "Bajo la licencia {}", "Published under {}", "Made available under the terms of the {}"]
#: Sentences that are no licence notice, many of them with the words of one.
NO_LICENCE = ["He lost his driving licence and had no permission to drive.", "The warranty of the machine is void after two years.", "See the license agreement for details.", "A fishing license is required in this area.", "Permission denied.", "Please ask for permission before you enter.", "The copyright of the song was sold.", "The library is licensed to a third party.", "The product is under warranty.", "Creative work is common in this studio.", "The public domain of the network is down.", "You must accept the terms of the license.", "Copyright law differs from country to country.", "The restaurant has a licence to sell wine.", "The rights were reserved for the family.", "Their business licence expires in version two of the plan.", "Terms and conditions apply.", "The general public was admitted without permission.", "An open license is a good choice for data.", "The foundation gave permission to publish the work.", "The software was written in a week and runs on any machine.", "You can find the source of the river in the hills.", "This file holds the results of the second run.", "It is free and open to the public on Sundays.", "The work of the author was published in three volumes.", "Version 2.0 of the program is faster than version 1.0.", "The university, known as MIT, published a study.", "Wir fahren mit dem Rad, und sie kommt mit dem Zug.", "Das Haus steht unter Wasser, mit allem, was darin ist.", "Er ging mit ihr und mit den Kindern.", "Mit der Zeit wurde es besser.", "Une licence de pilote est requise pour ce vol.", "La licencia de conducir caduca en mayo.", "Available in three colours and two sizes.", "The book was released in May.", "Distributed systems are hard to test.", "Dual carriageways are wider.", "The terms of the loan were made available later.", "Later, or at any time, the use of the code was limited.", "We reserve a table for two.", "The state of the art is described in the introduction.", "All the children were in the garden.", "In no event was the holder of the record present.", "The committee shall be included in all further talks.", "Some people like tea, and others like coffee.", "The results are provided in the table above.", "It was a dark night and the wind was strong.", "They are not able to come today.", "This is what was said by the people of that time.", "For the most part, there is no limit to it."]
#: Words too common to tell anything by themselves or with each other.
COMMON = ["the", "a", "an", "of", "and", "or", "to", "in", "is", "it", "be", "this", "that", "with", "for", "by", "on", "at", "as", "are", "was", "were", "if", "its", "has", "have", "but", "not", "into", "even", "can", "will", "he", "she", "they", "der", "die", "das", "und", "la", "le", "de", "en"]
UNKNOWN, NONE = "unknown", "none"
FAMILIES = [*TEMPLATES, UNKNOWN, NONE]
#: A paragraph ends at an empty line, or at the end of a line that ends a sentence; other line breaks are within it.
PARAGRAPH_END = r"\n[ \t\r]*\n\s*|(?<=[.!?:;])[ \t\r]*\n"


def tokens(text: Column) -> Column:
    """Words of letters, figures, dots and dashes, in lower case."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9.\-]+|\.(?![a-z0-9])", " ")
    return F.filter(F.split(F.trim(plain), " +"), lambda w: w != "")


def pairs(words: Column) -> Column:
    """Neighbouring words as one term each, once each."""
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def terms(words: Column) -> Column:
    """Words that are not too common, and pairs of neighbours with such a word, once each."""
    first, second = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(0)))
    telling = F.zip_with(first, second, lambda a, b: F.when(~(a.isin(COMMON) & b.isin(COMMON)), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.array_compact(F.concat(F.array_except(words, F.array(*[F.lit(w) for w in COMMON])), telling)))


def literal_rows(spark: SparkSession, kinds: str, rows: list[dict]) -> DataFrame:
    entries = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kinds}>>")
    return spark.range(1).select(F.explode(entries).alias("x")).select("x.*")


def variants(text: str) -> list[str]:
    """A template in the forms that documents have: whole, in part, with words left out or put around it."""
    words = text.split()
    out = [text, f"{text} See the file for details.", f"This file is part of the project. {text}", f"{text} Copyright the authors."]
    if len(words) >= 8:
        out += [" ".join(words[: len(words) * 2 // 3]), " ".join(words[len(words) // 3 :])]
        out += [" ".join(w for k, w in enumerate(words) if k % 7 != skip) for skip in range(3)]
    return out


def named(names: list[str]) -> list[list[str]]:
    """The notices that name a licence, by form."""
    return [[form.format(name) for name in names] for form in FORMS]


def examples() -> list[dict]:
    """Texts with their family (a place in FAMILIES) and fold: a template with all its variants, or all that is said in one form, is in one fold."""
    out = []

    def add(family: str, groups: list[list[str]]) -> None:
        out.extend({"text": text, "label": FAMILIES.index(family), "fold": k % 2} for k, group in enumerate(groups) for text in group)

    for family, texts in TEMPLATES.items():
        add(family, [variants(t) for t in texts])
        add(family, named(NAMES.get(family, [])))
    add(UNKNOWN, named(OTHER_NAMES))
    add(NONE, [[t, f"{t} Thank you.", f"It is known that {t}"] for t in NO_LICENCE])
    return out


@dataclass
class LicenceModel:
    """The fitted classifier, the temperature of its scores, the least chance at which a family is believed, and the words to look for."""

    stages: PipelineModel
    temperature: float
    least: float

    def rated(self, passages: DataFrame) -> DataFrame:
        """``passages`` (with words) plus family and chance."""
        return most_likely(self.raw(passages).drop("terms", "features", "rawPrediction", "probability", "prediction"), F.lit(self.temperature))

    def raw(self, passages: DataFrame) -> DataFrame:
        return self.stages.transform(passages.withColumn("terms", terms(F.col("words")))).withColumn("raw", vector_to_array("rawPrediction"))

    def needles(self) -> list[str]:
        """Words of which every paragraph that the classifier takes for a notice holds one.

        A paragraph is taken for one if the terms it holds raise a family over "none" by more than the constants put it below. Of
        the terms that raise a family, the weakest, which together cannot do so, need not be there: one of the others must.
        """
        count, classify = self.stages.stages
        weights, constants = classify.coefficientMatrix.toArray(), classify.interceptVector.toArray()
        vocabulary, none, out = count.vocabulary, FAMILIES.index(NONE), set()
        for k in range(len(FAMILIES)):
            if k == none:
                continue
            gain, short = weights[k] - weights[none], constants[none] - constants[k]
            if short < 0:
                raise ValueError(f"the model takes empty paragraphs for {FAMILIES[k]}")
            order = np.argsort(gain)
            order = order[gain[order] > 0]
            out.update(order[np.cumsum(gain[order]) > short].tolist())
        return sorted({max((w for w in vocabulary[k].split() if w not in COMMON), key=len) for k in out})

    def may_hold_notice(self) -> str:
        """A pattern for lower-case text that every such paragraph matches."""
        by_letter: dict[str, list[str]] = {}
        for word in self.needles():
            by_letter.setdefault(word[0], []).append(word[1:])
        quoted = [re_quoted(a) + "(?:" + "|".join(re_quoted(w) for w in rest) + ")" for a, rest in by_letter.items()]
        return "(?<![a-z0-9])(?:" + "|".join(quoted) + ")(?![a-z0-9])" if quoted else "(?!)"


def re_quoted(word: str) -> str:
    return word.replace(".", r"\.").replace("-", r"\-")


def softmax(raw: Column, temperature: Column) -> Column:
    top = F.array_max(raw)
    parts = F.transform(raw, lambda x: F.exp((x - top) / temperature))
    return F.get(F.transform(F.array(parts), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, y: a + y))), F.lit(0))


def most_likely(df: DataFrame, temperature: Column) -> DataFrame:
    names = F.array(*[F.lit(f) for f in FAMILIES])
    chances = df.withColumn("chances", softmax(F.col("raw"), temperature))
    return chances.withColumn("chance", F.array_max("chances")).withColumn("family", F.get(names, (F.array_position("chances", F.col("chance")) - 1).cast("int"))).drop("raw", "chances")


def _fitted(rows: DataFrame) -> PipelineModel:
    count = CountVectorizer(inputCol="terms", outputCol="features", binary=True, minDF=1.0).fit(rows)
    return PipelineModel([count, LogisticRegression(family="multinomial", regParam=0.001, elasticNetParam=0.3, maxIter=30, standardization=False).fit(count.transform(rows))])


def fit_licences(spark: SparkSession, false_share: float = 0.05) -> LicenceModel:
    """Train on the variants of the templates; calibrate on templates and forms that were not trained.

    Of two models each is trained on one half of the templates and rates the other half. The temperature is the one of a grid under which the
    true families of all these are likeliest; a family is believed from the chance that all but ``false_share`` of the paragraphs
    without a known family stay below. The model returned is trained on all.
    """
    rows = literal_rows(spark, "text:string, label:double, fold:int", examples()).withColumn("words", tokens(F.col("text"))).withColumn("terms", terms(F.col("words")))
    rows = stage(rows.coalesce(1), "licence-examples")
    rated = [LicenceModel(_fitted(rows.where(F.col("fold") != k)), 1.0, 0.0).raw(rows.where(F.col("fold") == k).drop("terms")).select("label", "raw") for k in range(2)]
    held = stage(reduce(DataFrame.unionByName, rated), "licence-held")
    grid = held.withColumn("temperature", F.explode(F.array(*[F.lit(x / 10) for x in range(2, 41, 2)])))
    loss = grid.select("temperature", F.log(F.get(softmax(F.col("raw"), F.col("temperature")), F.col("label").cast("int")) + 1e-12).alias("gain"))
    temperature = loss.groupBy("temperature").agg(F.sum("gain").alias("gain")).orderBy(F.desc("gain"), "temperature").first()["temperature"]
    wrong = most_likely(held.where(F.col("label") >= FAMILIES.index(UNKNOWN)), F.lit(temperature)).withColumn("taken", F.when(~F.col("family").isin(UNKNOWN, NONE), F.col("chance")).otherwise(0.0))
    least = wrong.agg(F.percentile("taken", 1 - false_share)).first()[0] or 0.0
    return LicenceModel(_fitted(rows), float(temperature), max(0.3, float(least)))


def confirmed(rated: DataFrame, spark: SparkSession, overlap: float) -> DataFrame:
    """(passage, agrees): the share of the shorter text's word pairs that passage and best template of the family share reaches ``overlap``."""
    known = [(f, t) for f in TEMPLATES for t in [*TEMPLATES[f], *sum(named(NAMES.get(f, [])), [])]]
    texts = literal_rows(spark, "family:string, template:int, text:string", [{"family": f, "template": k, "text": t} for k, (f, t) in enumerate(known)])
    known = texts.select("family", "template", pairs(tokens(F.col("text"))).alias("pairs")).select("family", "template", F.size("pairs").alias("size"), F.explode("pairs").alias("pair"))
    seen = rated.select("passage", "family", pairs(F.col("words")).alias("pairs")).select("passage", "family", F.size("pairs").alias("own"), F.explode("pairs").alias("pair"))
    shared = seen.join(F.broadcast(known), ["family", "pair"]).groupBy("passage", "template", "own", "size").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("passage").agg(F.max(F.col("n") / F.least("own", "size")).alias("overlap")).where(F.col("overlap") >= overlap).select("passage", F.lit(True).alias("agrees"))


def scan_licences(docs: DataFrame, id: str = "doc_id", text: str = "text", overlap: float = 0.6, model: LicenceModel | None = None, prefilter: bool = True) -> DataFrame:
    """(doc_id, licences, n_paragraphs, n_confirmed, n_unknown, chance) for each row of ``docs``.

    Texts are cut at empty lines and at lines that end a sentence, so a notice wrapped over lines is one paragraph. Each distinct paragraph
    is classified once; those without any word that a notice must hold by the model's own weights are left out before, which changes
    nothing. n_paragraphs counts what the classifier takes for a licence notice. A family counts if its chance reaches the
    calibrated bound and a template of the family agrees; every other notice is unknown. licences names the
    families of a text, in order and joined by commas; chance is that of its surest paragraph. NULL and empty texts and texts
    without a notice have no paragraph; repeated rows get equal results; an empty table gives an empty result. Only the id and the
    text are read.
    """
    spark = docs.sparkSession
    model = model or fit_licences(spark)
    may = model.may_hold_notice() if prefilter else "(?s).*"
    own = docs.select(F.xxhash64(F.col(id)).alias("k1"), F.xxhash64(F.col(text)).alias("k2"), F.lower(F.col(text)).alias("text"))
    passages = own.where(F.col("text").rlike(may)).select("k1", "k2", F.posexplode(F.split("text", PARAGRAPH_END, -1)).alias("pos", "line")).where(F.col("line").rlike(may))
    # repeated rows yield the same passages; each counts once
    passages = stage(passages.withColumn("passage", F.sha2("line", 256)).groupBy("k1", "k2", "pos").agg(F.first("passage").alias("passage"), F.first("line").alias("line")), "licence-passages")
    distinct = passages.groupBy("passage").agg(F.first("line").alias("line")).select("passage", tokens(F.col("line")).alias("words"))
    # written before it is filtered: a filter on the family would work it out twice
    rated = stage(model.rated(distinct), "licence-rated").where(F.col("family") != NONE)
    agreed = rated.select("passage", "family", "chance").join(confirmed(rated, spark, overlap), "passage", "left")
    sure = F.col("agrees").isNotNull() & (F.col("family") != UNKNOWN) & (F.col("chance") >= model.least)
    judged = agreed.select("passage", F.when(sure, F.col("family")).alias("licence"), "chance")
    per_text = passages.drop("line").join(judged, "passage").groupBy("k1", "k2").agg(
        F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"), F.count(F.lit(1)).alias("n_paragraphs"), F.count("licence").alias("n_confirmed"), F.max(F.when(F.col("licence").isNotNull(), F.col("chance"))).alias("chance")
    )
    rows = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.col(id)).alias("k1"), F.xxhash64(F.col(text)).alias("k2"))
    met = rows.join(per_text, ["k1", "k2"], "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_paragraphs", "n_confirmed")}
    return met.select("doc_id", F.coalesce("licences", F.lit("")).alias("licences"), n["n_paragraphs"].alias("n_paragraphs"), n["n_confirmed"].alias("n_confirmed"), (n["n_paragraphs"] - n["n_confirmed"]).alias("n_unknown"), F.round("chance", 3).alias("chance"))
