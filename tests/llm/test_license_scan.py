import re
import textwrap

import pyarrow as pa
import pytest

from strandlake.llm import license_scan as ls


@pytest.mark.parametrize(("family", "text"), ls.TEMPLATES)
def test_every_template_is_its_family(family, text):
    got, p, cover = ls.classify(f"Note: {text.upper()}.")
    assert (got, cover) == (family, 1.0) and p >= ls.MIN_PROBABILITY


@pytest.mark.parametrize("text", ls.OTHERS)
def test_prose_stays_prose(text):
    assert ls.classify(text)[0] == ls.PROSE


def test_unknown_licences_and_unseen_variants():
    assert ls.classify("Licensed under the Foo License")[0] == ls.UNKNOWN
    rows = ls._variants(99, 4)
    right = sum(int(ls.classifier().probabilities(w).argmax()) == y for w, y in rows)
    assert right / len(rows) > 0.95


def found(text):
    return [v[0] for lines in ls.candidates(pa.array([text])).get(0, []) for v in ls.verdicts(lines)]


@pytest.mark.parametrize(("family", "text"), [x for x in ls.TEMPLATES if len(x[1]) > 100])
@pytest.mark.parametrize("sign", ["", "// ", " * ", "# "])
def test_wrapped_notices_are_one_paragraph(family, text, sign):
    lines = [sign + x for x in textwrap.wrap(text, 40)]
    prose = "the sun rose over the hills and no one saw the boat leave"
    assert found("\n".join([prose, sign.strip(), *lines, sign.strip(), prose])) == [family]


def test_two_licences_on_lines_side_by_side():
    assert sorted(found("All rights reserved\nReleased under the MIT License\n")) == ["mit", "proprietary"]
    assert found("Released under the MIT License\n \nReleased under the MIT License") == ["mit", "mit"]


def test_a_notice_in_a_very_long_line():
    prose = "the sun rose over the hills and no one saw the boat leave " * 2000
    assert found(prose + "Licensed under the Apache License, Version 2.0. " + prose) == ["apache"]


@pytest.mark.parametrize(("family", "text"), [("mit", "SPDX-License-Identifier: MIT"), ("apache", "// SPDX-License-Identifier: Apache-2.0"), ("lgpl", "Released under the GNU LGPL version 3")])
def test_short_forms(family, text):
    assert found(text) == [family]


@pytest.mark.parametrize("text", [
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
    pytest.param("Everyone is permitted to copy and distribute verbatim or modified copies of this license document", marks=pytest.mark.xfail(reason="too little in common with the licences in training")),
    "SPDX-License-Identifier: Zlib", "This product is released under the Zope Public License",
])
def test_licences_outside_training_are_unknown(text):
    assert found(text) in ([ls.UNKNOWN], ["isc"])


def test_candidates_hold_every_pair_of_a_template(rows):
    """Brute force: every pair of adjacent words that a template has, blank lines apart, stands in a candidate."""
    seeds = set().union(*(ls._pairs(ls.tokens(t)) for _, t in ls.TEMPLATES))
    texts = [r[1] for r in rows] + ["a\nReleased under the MIT License.\nb", "x Licensed under CC BY 4.0", "released under\n//\nthe mit license", None]
    got = ls.candidates(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        want = sum(p in seeds for part in re.split(r"\n[^0-9A-Za-z\x80-\U0010ffff\n]*(?=\n)", text or "") for p in zip(ls.tokens(part), ls.tokens(part)[1:], strict=False))
        have = sum(p in seeds for lines in got.get(i, []) for p in zip(ls.tokens(" ".join(lines)), ls.tokens(" ".join(lines))[1:], strict=False))
        assert have >= want


def test_tables(spark, odd, none):
    frame = spark.createDataFrame([(1, "x\nAll rights reserved.\n\nALL RIGHTS RESERVED", "u"), (None, "Released under the MIT License", "v"), (2, None, "w")], "doc_id bigint, text string, family string")
    assert sorted(((r.doc_id, r.family, r.n_paragraphs) for r in ls.scan(frame).collect()), key=str) == [(1, "proprietary", 2), (None, "mit", 1)]
    assert ls.scan(odd).count() == 0 and ls.scan(none).count() == 0
