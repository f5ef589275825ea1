"""Corpus operators over the whole of their input, where a bound or a shortcut once left some of it out."""

from __future__ import annotations

import numpy as np

from terralane.llm import classifier, dedup, licenses


def test_the_good_share_covers_all_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    assert classifier.fit(docs, labels, fit_rows=10)[1] == sum(i % 7 != 0 for i in range(300)) / 300
    kept = classifier.select(docs, labels, fit_rows=10).where("kept").count()
    assert kept == sum(i % 7 != 0 for i in range(300))


def test_tiny_sets_share_a_band():
    """Sets of five, and the same less the last, that shared no band while registers went in steps."""
    apart = [
        [17386445975656691383, 16025891298616763409, 11760269219351915373, 12915679190702949131, 17504189534509703400],
        [17475181184743352459, 4066096839864220627, 1537700095950013813, 3690312714999884217, 17262134807880018390],
        [12923189539502143343, 12701712233057757540, 6355412175495298438, 5044490010846676033, 3524142045765961601],
        [15322568359416625379, 18106787083073123050, 15543897528683888876, 2546558236592538289, 3477219510856385040],
        [10159681611465429023, 11466634564148128217, 7032491894746280678, 4297969431050855787, 11313471933842564250],
        [16824389069998040272, 17200752137879959377, 17259825640404882189, 7661943001704817912, 7689056305237686772],
    ]
    both = np.array([x for s in apart for x in (*s, *s[:4])], np.uint64)
    bounds = np.concatenate([[0], np.cumsum([5, 4] * len(apart))])
    key = dedup.band_keys(dedup.registers(dedup.minima(both, bounds)))
    assert (key[::2] == key[1::2]).any(axis=1).all()
    low = dedup.minima(np.arange(1, 40, dtype=np.uint64), np.arange(40))
    assert np.isfinite(low).all()  # a lone element fills each register


def test_one_shingle_notices_meet_a_band():
    """Windows that held the one shingle of the MIT notice and met it in no band while orders were multiples of one number."""
    matcher = licenses.Matcher(licenses.TEMPLATES)
    shingle = matcher.sets[matcher.names.index("MIT")]
    assert shingle.tolist() == [10026449429665276323]
    windows = [
        [9617572355128830115, 10026449429665276323, 1774127090763867411, 10011330573627413273],
        [3975792923395013281, 15709875495410988510, 10026449429665276323, 5748408241380324003],
        [10026449429665276323, 18223605507658014200, 9767630279335527331, 5133410176605881229],
        [10026449429665276323, 11214597549631069274, 5864582963095115235, 13923908923214722149],
        [2848850630211462963, 2960643158927680483, 12275210362057793184, 10026449429665276323],
        [10026449429665276323, 10550887284298126563, 16818336235291267785, 369708611898640461],
    ]
    found = list(matcher.scan(np.array(windows, np.uint64).reshape(-1), np.arange(0, 4 * len(windows) + 1, 4)))
    assert {row for row, t, _, share in found if matcher.names[t] == "MIT" and share == 1} == set(range(len(windows)))
