"""The language model's steps, against sums over single places."""

from __future__ import annotations

import math

import numpy as np
import pytest

from brindle.llm import lm_score as lm


def test_totals_add_every_row_once():
    rng = np.random.default_rng(1)
    rows = rng.integers(-9, 9, (500, 3)).astype(np.float32)
    times = np.array([1, 2, lm.MOST - 1, lm.MOST, lm.MOST + 1, 3, lm.MOST**2, lm.MOST**2 + 1, 5 * lm.MOST**2 + 7, 1])
    source = rng.integers(0, 500, times.sum())
    starts = np.cumsum(times) - times
    want = np.array([rows[source[s : s + t]].sum(axis=0) for s, t in zip(starts, times)])
    assert (lm.totals(rows, source, starts, times) == want).all()
    assert (lm.totals(rows, source, starts[:2], times[:2]) == want[:2]).all()


@pytest.mark.parametrize("scale", [1, 60])
def test_step_follows_the_gradient_of_single_places(scale):
    size, hidden, rate = 40, 5, 0.7
    net = lm.Network(size, hidden)
    net.flat *= np.float32(scale)
    rng = np.random.default_rng(2)
    stream, firsts = lm.lay_out([rng.integers(1, size, n).astype("<u2") for n in (1, 2, 90, 7, 200)] + [np.full(120, 3, "<u2")])
    at = np.concatenate([f + lm.places_of(n, 1, 2) for f, n in zip(firsts.tolist(), (1, 2, 90, 7, 200, 120))])
    a = [v.astype(np.float64) for v in (net.embed, net.b, net.wc, net.bc, net.ww, net.bw)]
    embed, b, wc, bc, ww, bw = a
    change = [np.zeros_like(v) for v in a]
    of_class = net.class_at(stream[at].astype(int))
    times = {(k, w): n for k, p in enumerate(lm.PLACES) for w, n in zip(*np.unique(stream[at + p], return_counts=True))}
    scores = []

    def missed(z, own):
        p = np.exp(z - z.max())
        p /= p.sum()
        scores[-1] += math.log(p[own])
        p[own] -= 1
        return p

    for i, c in zip(at.tolist(), of_class.tolist()):
        scores.append(0.0)
        h = np.tanh(b + sum(embed[k][stream[i + p]] for k, p in enumerate(lm.PLACES)))
        own = slice(net.begins[c], net.begins[c + 1])
        p, q = missed(wc @ h + bc, c), missed(ww[own] @ h + bw[own], stream[i] - net.begins[c])
        dh = (p @ wc + q @ ww[own]) * (1 - h * h) * rate * 0.05
        alike = (of_class == c).sum()
        for j, x in ((1, dh / len(at)), (2, np.outer(p, h) * rate / len(at)), (3, p * rate / len(at))):
            change[j] += x
        change[4][own] += np.outer(q, h) * rate / alike
        change[5][own] += q * rate / alike
        for k, place in enumerate(lm.PLACES):
            w = stream[i + place]
            change[0][k][w] += dh * min(1, lm.REPEATS / times[k, w])
    assert np.abs(net.log_probability_at(stream, at) - scores).max() < 1e-3 * scale
    net.step(stream, at, rate)
    for before, less, after in zip(a, change, (net.embed, net.b, net.wc, net.bc, net.ww, net.bw)):
        assert np.abs(before - less - after).max() < 1e-5 * scale


def test_classes_of_rarer_words_are_worked_out_once_an_ending(monkeypatch):
    calls, real = [], lm.class_of
    monkeypatch.setattr(lm, "class_of", lambda word, buckets: calls.append(word) or real(word, buckets))
    words = [a + b + "ing" for a in "bdfgklm" for b in "aeiou"] + ["top"]
    windows = {s[i : i + 4]: 1 for w in words for s in [lm.letters_of(w, real(w, 7))] for i in range(len(s) - 3)}
    vocabulary = lm.Vocabulary(["top"], 7, lm.Letters(*lm.Letters.arrays(windows)))
    ids, spelt = vocabulary(words)
    assert ids.tolist() == [real(w, 7) for w in words[:-1]] + [8] and spelt[-1] == 0 and (spelt[:-1] < 0).all()
    assert len(calls) == 1
