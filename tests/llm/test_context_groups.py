"""Texts gone through together get what each gets alone."""

import numpy as np
import pyarrow as pa

from habitspark.llm import contextmix


def _texts(n, symbols=30):
    rng = np.random.default_rng(6)
    return [rng.integers(0, symbols, size).astype(np.uint16) for size in rng.integers(1, 700, n)]


def _alphabet():
    size = contextmix.MAGNITUDES * contextmix.ENDINGS
    zero = np.zeros(size, np.int64)
    return contextmix.Alphabet(np.arange(30, dtype=np.uint64), np.arange(1, 31), zero, zero, 465, 30)


def test_groups_hold_every_text_once():
    texts = _texts(40)
    column = pa.array([t.tobytes() for t in texts], pa.binary())
    groups = list(contextmix._groups(column, 1000))
    assert len(groups) > 5 and max(sum(map(len, g)) for g in groups) <= 1700
    assert [t.tolist() for g in groups for t in g] == [t.tolist() for t in texts]
    assert list(contextmix._groups(column[:0])) == []


def test_domain_round_is_the_sum_of_single_texts():
    alphabet, texts = _alphabet(), _texts(40)
    domains = contextmix.fit_domains(alphabet, [t.astype(np.int64) for t in texts[:10]])
    spelled = np.r_[texts[0], contextmix.BYTES + 65].astype(np.uint16)  # bytes of spelled words do not count
    total = np.zeros(domains.shape, np.int64)
    for t in [texts[0], *texts[1:]]:
        fit = domains[t].astype(float).sum(axis=0)
        share = np.exp(fit - fit.max())
        np.add.at(total, t, np.rint(share / share.sum() * 1024).astype(np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in [spelled, *texts[1:]]], pa.binary())], ["seen_less"])
    (got,) = contextmix._domain_round(domains)(iter([batch]))
    sums = np.zeros(domains.shape, np.int64)
    sums.ravel()[got.column(0).to_numpy()] = got.column(1).to_numpy()
    assert np.array_equal(sums, total)


def test_texts_are_scored_apart():
    alphabet, texts = _alphabet(), _texts(12)
    domains = contextmix.fit_domains(alphabet, [t.astype(np.int64) for t in texts])
    mixer = contextmix.Mixer(alphabet, domains, [])
    alone = [mixer.run([t])[0] for t in texts]
    # longer ones go on after others have ended
    assert np.allclose(mixer.run(texts), alone, rtol=0, atol=1e-9)
    assert np.allclose(mixer.run(texts[::-1]), alone[::-1], rtol=0, atol=1e-9)
