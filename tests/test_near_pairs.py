import random

import pytest

from memlake.operators import documents as D


@pytest.mark.parametrize("few", [0, 1 << 22])
def test_all_pairs_within_six_bits(spark, monkeypatch, few):
    """Keys of two and of three blocks find the same pairs, which are all; two make a third of the rows."""
    monkeypatch.setattr(D, "FEW_PRINTS", few)
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), k)) for p in prints[:30] for k in (1, 5, 6, 7)]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    sizes, plain = {}, D.written
    monkeypatch.setattr(D, "written", lambda df, name: sizes.setdefault(name, plain(df, name)))
    got = {tuple(r) for r in D.near_pairs(spark.createDataFrame(rows, "id long, fingerprint long")).collect()}
    assert got == {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (prints[a] ^ prints[b]).bit_count() <= 6}
    assert sizes["simhash-keys"].count() == len(set(prints)) * (28 if few else 84)
