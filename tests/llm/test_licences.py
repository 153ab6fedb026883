import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from meadowlark.llm import licences
from tests.llm.licence_notices import HARMLESS, NOTICES


def _families(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["paragraph"], r["family"], r["confirmed"]) for r in licences.find_licences(docs).orderBy("paragraph").collect()]


@pytest.mark.parametrize(
    ("line", "family"),
    [
        ("Licensed under CC BY-NC 4.0.", "cc_by_nc"), ("Licensed under CC BY 4.0", "cc_by"), ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("(c) 2020 the team. Licensed under the Mozilla Public License 2.0", "mpl"),
    ],
)
def test_families(spark, line, family):
    assert _families(spark, f"Some words first.\n{line}\nand more") == [(1, family, True)]


def test_look_alikes_name_nothing(spark):
    found = _families(spark, "\n".join(["He lost his driver license.", "permission is granted to visit the museum", "The MIT lab", "licensed under the Foo Public License, version 9"]))
    assert all(family == licences.UNKNOWN and not confirmed for _, family, confirmed in found)


def test_every_template_is_found(spark):
    docs = spark.createDataFrame(list(enumerate(t for _, t in licences.TEMPLATES)), "doc_id long, text string")
    found = {r["doc_id"]: r["family"] for r in licences.find_licences(docs).collect()}
    right = [found.get(k) == f for k, (f, _) in enumerate(licences.TEMPLATES)]
    assert sum(right) >= len(right) - 2


def test_wrapped_notices_are_found(spark):
    long = [(k, family, text) for k, (family, text) in enumerate(licences.TEMPLATES) if len(text) > 50]
    docs = [(k * 1000, text) for k, _, text in long]
    docs += [(k * 1000 + width, "\n".join(["", *(f"# {line}" for line in textwrap.wrap(text, width)), "#", "some more words"])) for k, _, text in long for width in range(50, 81, 5)]
    found = {}
    for r in licences.find_licences(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], []).append((r["family"], r["containment"], r["confirmed"]))
    assert [key for key, _ in docs if found.get(key) != found.get(key // 1000 * 1000)] == []
    assert sum(found.get(k * 1000) == [(family, 1.0, True)] for k, family, _ in long) >= len(long) - 2


def test_neighbouring_notices_stay_apart(spark):
    assert _families(spark, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.") == [(0, "cc_by_nc", True), (1, "mit", True)]
    wrapped = "Licensed under a Creative Commons Attribution\nShareAlike 4.0 International License"
    assert _families(spark, wrapped) == _families(spark, wrapped.replace("\n", " ")) == [(0, "cc_by_sa", True)]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = licences.find_licences(docs.withColumn("family", F.lit("x")))
    expected = docs.where(F.lower("text").contains("licen")).count()
    assert found.where("confirmed").select("doc_id").distinct().count() == expected == found.count()
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_odd_empty_and_repeated(spark, odd_docs, no_docs):
    assert licences.find_licences(odd_docs).collect() == [] and licences.find_licences(no_docs).collect() == []
    twice = spark.createDataFrame([(1, "Released under the MIT License.")] * 2, "doc_id long, text string")
    assert licences.find_licences(twice).count() == 2


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""
BSD_TERMS = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""


@pytest.mark.parametrize(
    ("text", "family"),
    [
        (MIT_GRANT, "mit"), (BSD_TERMS, "bsd"), ("// SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache"), ("MIT License", "mit"),
        ("Boost Software License - Version 1.0 - August 17th, 2003", "boost"), ("Licensed under the EUPL, Version 1.2 or later", "eupl"),
    ],
)
def test_published_notices(spark, text, family):
    assert family in {f for _, f, confirmed in _families(spark, f"some words\n{text}\nother words") if confirmed}


def _judged(text):
    """What a whole paragraph is by the model's weights, summed in Python: (family, probability, containment, confirmed) or None."""
    model = licences.trained()
    place = {p: k for k, p in enumerate(model.vocabulary)}
    own = [place[p] for p in licences.pairs_of(text) if p in place]
    if not any(model.owner[i] >= 0 for i in own):
        return None
    z = model.bias + model.weights[own].sum(0)
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    best = int(p[:-1].argmax())
    shares = []
    for k in range(len(licences.TEMPLATES)):
        of_template = np.flatnonzero(model.members[:, k])
        there = [i for i in of_template if i in own]
        plain, weighed = len(there) / len(of_template), sum(1 / model.shared[i] for i in there) / sum(1 / model.shared[i] for i in of_template)
        shares.append(min(plain, weighed) if len(of_template) >= licences.WHOLE else float(plain == 1))
    share = max(s for s, (f, _) in zip(shares, licences.TEMPLATES) if f == licences.FAMILIES[best])
    if (p[best] < model.threshold or share < licences.RESEMBLES) and max(shares) < licences.CONFIRM:
        return None
    confirmed = p[best] >= model.threshold and share >= licences.CONFIRM and any(model.owner[i] == best for i in own)
    return licences.FAMILIES[best] if confirmed else licences.UNKNOWN, p[best], share, confirmed


def test_scores_equal_plain_python(spark):
    """Each line's probability and containment from the model's weights, summed in Python over the line's word pairs."""
    lines = [t for _, t in licences.TEMPLATES] + list(licences.LOOK_ALIKES) + [t for _, t in NOTICES] + list(HARMLESS) + ["nothing of that kind here"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licences.find_licences(docs).collect()}
    for k, line in enumerate(lines):
        expected = _judged(line)
        assert (k in found) == (expected is not None), line
        if expected is not None:
            family, p, share, confirmed = expected
            assert (found[k]["family"], found[k]["confirmed"]) == (family, confirmed), line
            assert abs(found[k]["probability"] - p) < 1e-4 and abs(found[k]["containment"] - share) < 1e-5


def test_runs_equal_plain_python(spark):
    """A wrapped notice is judged by the pairs of all its lines; pairs that end one line and start the next are held once."""
    texts = [(k, t, textwrap.fill(t, 40)) for k, (_, t) in enumerate(licences.TEMPLATES) if len(t) > 60]
    docs = spark.createDataFrame([(k, wrapped) for k, _, wrapped in texts], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licences.find_licences(docs).where("confirmed and paragraph = 0").collect()}
    for k, text, _ in texts:
        family, p, share, confirmed = _judged(text)
        assert confirmed and found[k]["family"] == family and abs(found[k]["probability"] - p) < 1e-4 and abs(found[k]["containment"] - share) < 1e-5


def test_published_notices_and_harmless_sentences(spark):
    lines = [t for _, t in NOTICES] + list(HARMLESS)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    confirmed = {r["doc_id"]: r["family"] for r in licences.find_licences(docs).where("confirmed").collect()}
    assert all(k < len(NOTICES) and NOTICES[k][0] == family for k, family in confirmed.items())
    assert len(confirmed) >= 0.9 * len(NOTICES)


def test_long_runs_hold_distinct_pairs_only(spark):
    """A notice repeated over some 25,000 wrapped lines: as many runs as repeats, each judged like the first."""
    text = "\n".join([textwrap.fill(BSD_TERMS, 30)] * 5000)
    found = _families(spark, text)
    assert len(found) == 5000 and {(f, confirmed) for _, f, confirmed in found} == {("bsd", True)}


def test_one_run_of_very_many_lines(spark):
    """Each line's end and the next line's start are a pair of a template, so that all lines are one run."""
    line = "software is provided as is, without warranty of any kind, express or implied. The"
    assert _families(spark, "\n".join([line] * 25_000)) == _families(spark, "\n".join([line] * 3)) == [(0, "mit", True)]
