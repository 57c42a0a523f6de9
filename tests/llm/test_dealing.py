from __future__ import annotations

import numpy as np
import pytest

from marque.llm import dealing, lm_scores
from marque.llm.dealing import Deal, Packed, united
from tests.llm.test_text_ops import test_lm_scores_equal_brute_force as lm_scores_equal_brute_force


def entries(rnd, n=500, texts=40):
    who = np.sort(rnd.choice(10**6, texts, False)).astype(np.uint64)
    return Packed(who, rnd.integers(0, texts, n), [rnd.integers(0, 2**63, n).astype(np.uint64), rnd.normal(size=n)], (who * np.uint64(7),), np.array([None if w % np.uint64(5) == 0 else f"é{w}" for w in who], object))


def listed(p):
    return sorted(zip(p.who[p.of].tolist(), p.cols[0].tolist(), p.cols[1].tolist(), p.about[0][p.of].tolist(), [str(x) for x in p.names[p.of]], strict=True))


def test_packing_is_reversible():
    rnd = np.random.default_rng(1)
    a, b = entries(rnd), entries(rnd)
    assert listed(Packed.read(a.data())) == listed(a)
    assert listed(united([a.data(), b.data()])) == sorted(listed(a) + listed(b))
    none = Packed(a.who[:0], a.of[:0], [c[:0] for c in a.cols])
    assert len(Packed.read(none.data())) == 0


@pytest.mark.parametrize("blocks", [12, 70_000, 10**6])
def test_blocks_come_from_the_whole_hash(spark, blocks):
    """More than 65,536 blocks are all used, and evenly."""
    deal = Deal.of(spark, blocks)
    assert deal.base <= dealing.FAN and deal.blocks >= blocks
    x = np.random.default_rng(2).integers(0, 2**64, 4 * deal.blocks, np.uint64)
    n = np.bincount(deal.place(x), minlength=deal.blocks)
    assert len(n) == deal.blocks and n.max() < 40 and (n > 0).mean() > 0.95


@pytest.mark.parametrize("fan,blocks", [(256, 12), (4, 12), (3, 20)])
def test_entries_come_to_their_blocks_in_few_rows(spark, monkeypatch, fan, blocks):
    monkeypatch.setattr(dealing, "FAN", fan)
    deal = Deal.of(spark, blocks)
    rnd = np.random.default_rng(3)
    sent, rows = [], []
    for src in range(30):
        e = entries(rnd)
        made = list(deal.rows(1, src, deal.place(e.cols[0]), e))
        assert len(made) <= max(fan, deal.base)
        sent += listed(e)
        rows += made
    got = deal.dealt(spark.createDataFrame(rows, dealing.SCHEMA), lambda kind, e: deal.place(e.cols[0])).collect()
    assert len(got) <= fan * max(len(rows), deal.blocks)
    came = []
    for r in got:
        e = Packed.read(bytes(r.data))
        assert {deal.key(int(b)) for b in deal.place(e.cols[0])} == {r.task}
        came += listed(e)
    assert sorted(came) == sorted(sent)


@pytest.mark.parametrize("fan,size", [(3, 100), (2, 40)])
def test_lm_scores_in_levels(spark, monkeypatch, fan, size):
    monkeypatch.setattr(dealing, "FAN", fan)
    monkeypatch.setattr(lm_scores, "BLOCK_BYTES", size)
    lm_scores_equal_brute_force(spark)
