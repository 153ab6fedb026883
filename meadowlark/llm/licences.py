"""Licence scans: each paragraph is classified by its word pairs and confirmed against licence templates.

A paragraph is a line, or a run of lines over whose ends a template's word pairs go on (a wrapped notice).

A softmax regression on word pairs is fitted in the driver on variations of the templates and on paragraphs that merely
sound alike; an unknown class takes the latter. Applying it is DataFrame work only: paragraphs are exploded into word
pairs, a broadcast table (its size is fixed by the templates) numbers those of the vocabulary, and each paragraph's
distinct numbers are summed up with the model's weights. Digits count as 0, so a template holds for every version.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sentences of published licences and their usual headers, as (family, sentence).
SENTENCES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Apache License, Version 2.0, January 2004"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("wtfpl", "Do What The Fuck You Want To Public License"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
)
#: The names and SPDX identifiers by which licences are called, by family.
NAMES = {
    "mit": ("MIT", "MIT License", "MIT Licence", "MIT licensed", "MIT/X11 License", "Expat License"),
    "apache": ("Apache-2.0", "Apache License, Version 2.0", "Apache License", "Apache Software License", "Apache 2.0 License", "ASL 2.0"),
    "gpl": ("GPL-3.0", "GNU General Public License", "GNU GPL", "GNU General Public License, version 3", "GPL v3", "GPL license", "under GPLv3", "the GPLv3", "License: GPLv3"),
    "lgpl": ("LGPL-3.0", "GNU Lesser General Public License", "GNU Lesser General Public License version 3", "GNU Library General Public License", "GNU LGPL", "under LGPLv3", "the LGPLv3"),
    "agpl": ("AGPL-3.0", "GNU Affero General Public License", "GNU Affero General Public License version 3", "GNU AGPL", "under AGPLv3", "the AGPLv3"),
    "bsd": ("BSD-3-Clause", "BSD License", "3-Clause BSD License", "BSD 3-Clause License", "Modified BSD License", "New BSD License", "BSD style license"),
    "mpl": ("MPL-2.0", "Mozilla Public License", "Mozilla Public License 2.0", "MPL v2"),
    "cc_by": ("CC-BY-4.0", "CC BY license", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"),
    "cc_by_sa": ("CC-BY-SA-4.0", "CC BY-SA license", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-Share Alike"),
    "cc_by_nc": ("CC-BY-NC-4.0", "CC BY-NC license", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"),
    "cc_by_nd": ("CC-BY-ND-4.0", "CC BY-ND license", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivs"),
    "cc_by_nc_sa": ("CC-BY-NC-SA-4.0", "CC BY-NC-SA license", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc_by_nc_nd": ("CC-BY-NC-ND-4.0", "CC BY-NC-ND license", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "cc0": ("CC0-1.0", "CC0 license", "CC0 public domain dedication", "Creative Commons Zero", "Creative Commons CC0"),
    "isc": ("ISC", "ISC License", "ISC Licence"),
    "unlicense": ("Unlicense", "The Unlicense license"),
    "boost": ("BSL-1.0", "Boost Software License", "Boost Software License Version 1.0"),
    "eupl": ("EUPL-1.2", "European Union Public Licence", "European Union Public License", "the EUPL", "EUPL v1.2"),
    "zlib": ("Zlib", "zlib License", "zlib/libpng license"),
    "epl": ("EPL-2.0", "Eclipse Public License", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0"),
    "cddl": ("CDDL-1.0", "Common Development and Distribution License", "CDDL license"),
    "artistic": ("Artistic-2.0", "Artistic License", "Artistic License 2.0"),
    "wtfpl": ("WTFPL", "WTFPL license", "the WTFPL"),
    "ofl": ("OFL-1.1", "SIL Open Font License", "Open Font License"),
    "gfdl": ("GFDL-1.3", "GNU Free Documentation License", "GNU FDL"),
    "psf": ("PSF-2.0", "Python Software Foundation License", "PSF License"),
    "ms_pl": ("MS-PL", "Microsoft Public License"),
    "postgresql": ("PostgreSQL", "PostgreSQL License"),
    "odbl": ("ODbL-1.0", "Open Database License", "Open Data Commons Open Database License"),
}
#: Sentences that share words with the notices and name no licence.
LOOK_ALIKES = (
    "he lost his driver license on the way to the office",
    "the restaurant was granted a liquor license by the city",
    "researchers at mit released a new report under embargo",
    "the apache people live in the southwest",
    "general public access to the park is free of charge",
    "permission is granted to visit the museum on sundays",
    "this work is part of a larger series",
    "the software is provided by the school to every student",
    "you may not use this door except in an emergency",
    "subject to the terms of the contract the tenant pays rent",
    "all rights of the workers were reserved by law",
    "creative work in common spaces needs attribution of costs",
    "licensed under the terms of a private agreement between the parties",
    "licensed under the rules of the national board of physicians",
    "a copy of this letter was sent to any person who asked",
    "released under the supervision of the court",
    "the motion was passed by a wide margin in version 2 0 of the vote",
    "licensed under the foo public license version 9",
    "the european union opened a common development bank for public health",
    "the open database of the library is made available to the general public",
    "an artistic work of the modified version 2 0 was shown",
)
UNKNOWN = "unknown"
#: Shares of a template that confirm it and that make a likely paragraph worth a report; wrong confirmations that the
#: threshold allows.
CONFIRM, RESEMBLES, ERRORS = 0.6, 0.4, 0.01
#: Templates of fewer word pairs are names, which must stand whole.
WHOLE = 5
#: Weights and worths are summed as whole numbers of this fineness.
WEIGHT, WORTH = 100_000, 1_000_000_000
_SMALL = set("of and to in is it a an or at by for this that with on as be are any the".split())


def words_of(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased; digits in a row are one 0."""
    return re.split(r"[^a-z0-9]+", re.sub("[0-9]+", "0", text.lower()))


def pairs_of(text: str) -> set[str]:
    """Distinct word pairs of a text."""
    words = words_of(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def _templates() -> tuple[tuple[str, str], ...]:
    """(family, words): the sentences, the names of two words and more, and the tags of the identifiers."""
    named = [(family, name) for family, (_, *names) in NAMES.items() for name in names]
    spelled = [(family, spdx) for family, (spdx, *_) in NAMES.items() if len(words_of(spdx)) > 1]
    tagged = [(family, f"SPDX-License-Identifier: {spdx}") for family, (spdx, *_) in NAMES.items()]
    listed = [(family, " ".join(w for w in words_of(text) if w)) for family, text in (*SENTENCES, *named, *spelled, *tagged)]
    return tuple((family, text) for family, text in dict.fromkeys(listed) if " " in text)


TEMPLATES = _templates()
FAMILIES = tuple(dict.fromkeys(f for f, _ in TEMPLATES)) + (UNKNOWN,)


class Licences(NamedTuple):
    """The vocabulary of word pairs with the model's weights; ``members`` says which templates hold a pair, ``shared`` by
    how many families it is used, and ``owner`` names the one family (number) that alone uses it, or -1."""

    vocabulary: list[str]
    weights: np.ndarray
    bias: np.ndarray
    threshold: float
    members: np.ndarray
    shared: np.ndarray
    owner: np.ndarray


_CARRIERS = ("licensed under the", "released under the", "distributed under the", "available under", "this work is licensed under a", "under the terms of the", "license", "")


def _examples(r: random.Random, n: int) -> list[tuple[str, int]]:
    filler = "software file code library project document data text page holder 2019 2023 version copy team note example".split()
    whole = [text for _, text in TEMPLATES]
    rows = []
    for _ in range(n):
        if r.random() < 0.6:
            family, text = r.choice(TEMPLATES)
            label = FAMILIES.index(family)
            if len(text.split()) < 8:  # a name stands in a sentence, whole
                words = [*r.choice(_CARRIERS).split(), *text.split()]
            else:
                words = [w for w in text.split() if r.random() > 0.06]
        else:
            label, words = len(FAMILIES) - 1, [w for w in r.choice(LOOK_ALIKES).split() if r.random() > 0.06]
            if r.random() < 0.4:  # scraps of notices name nothing by themselves
                notice = r.choice(whole).split()
                at = r.randrange(len(notice))
                scrap = notice[at : at + r.randint(2, 4)]
                words += scrap if not any(text in " ".join(scrap) for text in whole) else []
        before, after = ([r.choice(filler) for _ in range(r.randint(0, 5))] for _ in range(2))
        rows.append((" ".join([*before, *words, *after]), label))
    return rows


@lru_cache(maxsize=1)
def trained(n: int = 6000, seed: int = 5) -> Licences:
    """Fits on three quarters of ``n`` generated paragraphs; the rest sets the temperature and the threshold."""
    # the look-alikes' own pairs are features too: they speak for the unknown class
    listed = [t for _, t in TEMPLATES] + list(LOOK_ALIKES)
    vocabulary = sorted(p for p in set().union(*map(pairs_of, listed)) if not set(p.split()) <= _SMALL)
    place = {p: k for k, p in enumerate(vocabulary)}

    def rows(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(vocabulary)))
        for row, text in zip(x, texts):
            row[[place[p] for p in pairs_of(text) if p in place]] = 1
        return x

    examples = _examples(random.Random(seed), n)
    x, y = rows([t for t, _ in examples]), np.array([label for _, label in examples])
    held = np.arange(n) % 4 == 0
    goal = np.eye(len(FAMILIES))[y]
    weights, bias = np.zeros((len(vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES))

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    fit, target = x[~held].astype(np.float32), goal[~held].astype(np.float32)
    for _ in range(300):
        gap = softmax(fit @ weights.astype(np.float32) + bias.astype(np.float32)) - target
        weights -= 6.0 * (fit.T @ gap / len(fit) + 1e-5 * weights)
        bias -= 1.0 * gap.mean(0)
    raw = x[held] @ weights + bias
    loss = lambda t: -np.log(np.maximum(softmax(raw * t)[np.arange(len(raw)), y[held]], 1e-12)).mean()
    heat = min(np.linspace(0.25, 4, 76), key=loss)
    weights, bias = weights * heat, bias * heat

    members = np.array([[p in pairs_of(t) for _, t in TEMPLATES] for p in vocabulary])
    template_family = np.array([FAMILIES.index(f) for f, _ in TEMPLATES])
    of_family = np.array([members[:, template_family == f].any(1) for f in range(len(FAMILIES) - 1)]).T
    shared = of_family.sum(1)
    plain = set().union(*map(pairs_of, LOOK_ALIKES))
    owner = np.where((shared == 1) & np.array([p not in plain for p in vocabulary]), of_family.argmax(1), -1)
    model = Licences(vocabulary, weights, bias, 0.0, members, shared, owner)
    # the lowest threshold (more likely than not, at least) with which at most ERRORS of the held-out confirmations are wrong
    p = softmax(raw * heat)[:, :-1]
    best, sure = p.argmax(1), p.max(1)
    shares = contained(model, x[held])
    own = np.where(template_family[None] == best[:, None], shares, 0).max(1)
    confirmed = (own >= CONFIRM) & ((x[held] @ (owner[:, None] == np.arange(len(FAMILIES) - 1)))[np.arange(len(best)), best] > 0)
    order = np.flatnonzero(confirmed)[np.argsort(-sure[confirmed], kind="stable")]
    errors = np.cumsum(best[order] != y[held][order]) / np.arange(1, len(order) + 1)
    return model._replace(threshold=max(0.5, float(sure[order[np.flatnonzero(errors <= ERRORS)[-1]]])))


def contained(model: Licences, x: np.ndarray) -> np.ndarray:
    """Containment of each template in each row of ``x`` (which pairs of the vocabulary a text holds)."""
    worth = model.members / np.maximum(model.shared, 1)[:, None]
    plain = x @ model.members / model.members.sum(0)
    return np.where(model.members.sum(0) < WHOLE, np.floor(plain), np.minimum(plain, x @ worth / worth.sum(0)))


def _constant(values, kind: str) -> Column:
    """A value that the optimiser reads once, as a constant."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _rows(spark: SparkSession, values: list[dict], kind: str) -> DataFrame:
    """A small table of the model's figures: its size hangs on the templates alone."""
    return spark.range(1).select(F.inline(_constant(values, kind)))


def find_licences(docs: DataFrame, model: Licences | None = None) -> DataFrame:
    """One row per paragraph (line or run of lines) that is or resembles a licence notice.

    doc_id, paragraph (its first line, from 0), family (unknown where it isn't confirmed), probability, template (number),
    containment, confirmed. Containment is the share of a template's word pairs that the paragraph holds, or their share
    with each pair weighed by the inverse of how many families use it, whichever is less (names of fewer than WHOLE pairs:
    1 or 0); so what many licences say, and version numbers, confirm nothing. A paragraph is reported if it holds a pair
    that only one family uses, and some template is contained by CONFIRM, or a family's probability passes the calibrated
    threshold and one of its templates is contained by RESEMBLES. It is confirmed if the probability passes, a template of
    that family is contained, and one of its pairs is that family's alone. Where the likeliest family has no template with
    a pair in common, template is null and containment 0.

    Lines are a run where the word pair across their end is a template's; a confirmed run stands for its lines, save those
    that are confirmed alone for another family by a template that gains nothing from the run. Of a run that is not
    confirmed, its lines are reported, or the run if none of them is. Null and empty texts give none; repeated rows are
    reported each. Whole texts are read, however long; of a line or a run only its distinct pairs of the vocabulary are
    held. Only doc_id and text are taken, so further columns and their names don't matter.
    """
    model = model or trained()
    spark = docs.sparkSession
    k = len(FAMILIES)
    entries = [{"pair": p, "id": i} for i, p in enumerate(model.vocabulary)]
    # pairs of small words tell nothing, but a notice may be wrapped between them
    small = sorted(set().union(*(pairs_of(text) for _, text in TEMPLATES)) - set(model.vocabulary))
    entries += [{"pair": p, "id": None} for p in small]
    table = _rows(spark, entries, "array<struct<pair:string,id:int>>").select(F.xxhash64("pair").alias("pair"), "id")

    text = F.split(F.regexp_replace(F.lower(F.col("text").cast("string")), "[0-9]+", "0"), "\n")
    following = F.zip_with(text, F.slice(text, 2, F.greatest(F.size(text), F.lit(1))), lambda a, b: F.struct(a.alias("own"), b.alias("next")))
    # numbered before lines are exploded, so that a document's lines share their number
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    lines = numbered.select("doc_id", "row", F.posexplode(following).alias("paragraph", "line"))
    # each line with the first word of the next; the last pair of words is the one across the line's end
    first_next = F.coalesce(F.regexp_extract("line.next", "[a-z0-9]+", 0), F.lit(""))
    lines = lines.select("doc_id", "row", "paragraph", F.split(F.concat("line.own", F.lit(" "), first_next), "[^a-z0-9]+").alias("words"))
    hashed = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b)))
    lines = lines.select("doc_id", "row", "paragraph", hashed.alias("hashed"))
    across = F.get("hashed", F.size("hashed") - 2)
    inside = F.array_position("hashed", across) < F.size("hashed") - 1
    pairs = lines.select("doc_id", "row", "paragraph", across.alias("across"), inside.alias("inside"), F.explode(F.array_distinct("hashed")).alias("pair"))
    # the table is as large as the templates, whatever the corpus
    hits = pairs.join(F.broadcast(table), "pair")
    last = F.col("pair") == F.col("across")
    # at most one number for each word pair of the vocabulary
    grouped = hits.groupBy("row", "paragraph").agg(
        F.min("doc_id").alias("doc_id"),
        F.max(last).alias("goes_on"),
        F.collect_list(F.when(~last | F.col("inside"), F.col("id"))).alias("own"),
        F.collect_list("id").alias("ids"),
    )
    in_order = Window.partitionBy("row").orderBy("paragraph")
    joined = (F.lag("paragraph").over(in_order) == F.col("paragraph") - 1) & F.lag("goes_on").over(in_order)
    starts = F.when(F.coalesce(joined, F.lit(False)), None).otherwise(F.col("paragraph"))
    grouped = grouped.withColumn("run", F.last(starts, ignorenulls=True).over(in_order))
    grouped = grouped.withColumn("n_lines", F.count(F.lit(1)).over(Window.partitionBy("row", "run")))
    # each line counts for its run and, unless it is a run by itself, alone; a run's numbers are kept distinct while they meet
    of_run = F.struct(F.lit(False).alias("alone"), F.col("run").alias("paragraph"), "ids")
    of_line = F.struct(F.lit(True).alias("alone"), "paragraph", F.col("own").alias("ids"))
    parts = grouped.select("doc_id", "row", "run", F.explode(F.when(F.col("n_lines") > 1, F.array(of_run, of_line)).otherwise(F.array(of_run))).alias("part"))
    parts = parts.select("doc_id", "row", "run", "part.alone", "part.paragraph", F.explode("part.ids").alias("id"))
    parts = parts.groupBy("row", "run", "alone", "paragraph").agg(F.min("doc_id").alias("doc_id"), F.sort_array(F.collect_set("id")).alias("ids"))
    owned = [i for i, owner in enumerate(model.owner) if owner >= 0]
    parts = parts.where(F.arrays_overlap("ids", _constant(owned, "array<int>")))

    # what each number adds: to every family its weight, to each template that holds the pair its worth; whole numbers,
    # so that the sums don't hang on their order
    shared = np.maximum(model.shared, 1)
    adds = []
    for i, (w, held, n) in enumerate(zip(model.weights, model.members, shared)):
        of_families = [{"slot": f, "adds": round(float(v) * WEIGHT), "own": int(model.owner[i] == f)} for f, v in enumerate(w)]
        adds.append({"id": i, "slots": of_families + [{"slot": k + int(m), "adds": round(WORTH / int(n))} for m in np.flatnonzero(held)]})
    worths = (model.members * np.rint(WORTH / shared).astype(int)[:, None]).sum(0)
    slots = [{"slot": f, "family": f, "bias": float(v)} for f, v in enumerate(model.bias)]
    slots += [{"slot": k + m, "template": m, "family": FAMILIES.index(f), "size": int(model.members[:, m].sum()), "worth": int(worths[m])} for m, (f, _) in enumerate(TEMPLATES)]
    added = _rows(spark, adds, "array<struct<id:int,slots:array<struct<slot:int,adds:long,own:int>>>>")
    known = _rows(spark, slots, "array<struct<slot:int,template:int,family:int,bias:double,size:int,worth:long>>")
    # all within the partitions that the runs are in: sums by slot, of which there are as many as families and templates
    part = ["row", "run", "alone", "paragraph"]
    sums = parts.select(*part, "doc_id", F.explode("ids").alias("id")).join(F.broadcast(added), "id")
    sums = sums.select(*part, "doc_id", F.explode("slots").alias("s")).groupBy(*part, F.col("s.slot").alias("slot"))
    sums = sums.agg(F.min("doc_id").alias("doc_id"), F.sum("s.adds").alias("v"), F.sum("s.own").alias("own"), F.count(F.lit(1)).alias("n")).join(F.broadcast(known), "slot")
    share = F.when(F.col("size") < WHOLE, (F.col("n") == F.col("size")).cast("double")).otherwise(F.least(F.col("n") / F.col("size"), F.col("v") / F.col("worth")))
    of_family = F.when(F.col("template").isNull(), F.struct((F.col("v") / WEIGHT + F.col("bias")).alias("z"), (-F.col("family")).alias("family"), (F.col("own") > 0).alias("named")))
    of_template = F.when(F.col("template").isNotNull(), F.struct(share.alias("share"), "template", "family"))
    scored = sums.groupBy(*part).agg(F.min("doc_id").alias("doc_id"), F.collect_list(of_family).alias("z"), F.collect_list(of_template).alias("all"))
    scored = scored.select("*", F.array_max(F.filter("z", lambda x: x["family"] > 1 - k)).alias("best"), F.array_max("z")["z"].alias("top"))
    total = F.aggregate("z", F.lit(0.0), lambda x, z: x + F.exp(z["z"] - F.col("top")))
    found = scored.select(*part, "doc_id", "all", (-F.col("best.family")).alias("likeliest"), "best.named", (F.exp(F.col("best.z") - F.col("top")) / total).alias("p"), F.array_max("all").alias("any"))
    found = found.withColumn("own", F.array_max(F.filter("all", lambda x: x["family"] == F.col("likeliest"))))
    passes = F.col("p") >= model.threshold
    found = found.where((passes & (F.col("own.share") >= RESEMBLES)) | (F.col("any.share") >= CONFIRM))
    found = found.withColumn("confirmed", passes & F.coalesce(F.col("own.share") >= CONFIRM, F.lit(False)) & F.col("named"))
    same_run = Window.partitionBy("row", "run")
    found = found.withColumn("whole", F.max(F.when(~F.col("alone") & F.col("confirmed"), F.struct(F.col("likeliest").alias("family"), "all"))).over(same_run))
    found = found.withColumn("of_lines", F.max("alone").over(same_run))
    gains = F.exists("whole.all", lambda x: (x["template"] == F.col("own.template")) & (x["share"] > F.col("own.share")))
    kept = (
        F.when(~F.col("alone"), F.col("confirmed") | ~F.col("of_lines"))
        .when(F.col("whole").isNull(), True)
        .otherwise(F.col("confirmed") & (F.col("likeliest") != F.col("whole.family")) & ~gains)
    )
    return found.where(kept).select(
        "doc_id",
        F.col("paragraph").cast("int").alias("paragraph"),
        F.when(F.col("confirmed"), F.get(_constant(FAMILIES, "array<string>"), F.col("likeliest"))).otherwise(UNKNOWN).alias("family"),
        F.round("p", 6).alias("probability"),
        F.col("own.template").alias("template"),
        F.round(F.coalesce("own.share", F.lit(0.0)), 6).alias("containment"),
        "confirmed",
    )
