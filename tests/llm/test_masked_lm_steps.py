"""Training steps of the masked network against plain formulas, what they hold, and words found by two patterns."""

import re
import sys
import tracemalloc

import numpy as np

from postmill.llm import masked_lm as lm


def plainly(net, window, target, rate):
    """Gradient steps as a textbook has them, in double precision."""
    context, hidden_bias, out, bias = (np.array(x, float) for x in (net.context, net.hidden_bias, net.out, net.bias))
    seen = [np.full(x.shape, 1e-2) for x in (context, hidden_bias, out, bias)]
    for at in range(0, len(target), lm._BATCH):
        words, wanted = window[:, at : at + lm._BATCH], target[at : at + lm._BATCH]
        hidden = np.tanh(hidden_bias + sum(context[p][words[p]] for p in range(2 * lm.SIDE)))
        logits = hidden @ out + bias
        error = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (error / error.sum(axis=1, keepdims=True) - np.eye(lm.CLASSES)[wanted]) / len(wanted)
        back = (error @ out.T) * (1 - hidden * hidden)
        moved = np.zeros_like(context)
        for place in range(2 * lm.SIDE):
            np.add.at(moved[place], words[place], back)
        for value, step, past in zip((context, hidden_bias, out, bias), (moved, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)), seen, strict=True):
            past += step * step
            value -= rate * step / np.sqrt(past)
    return context, hidden_bias, np.clip(out, -3, 3), np.clip(bias, -20, 20)


def some(n):
    pick = np.random.default_rng(3)
    codes = np.minimum(pick.zipf(1.3, n), lm.CLASSES - 1).astype(np.uint8)
    window, target, _ = lm._windows([codes.tobytes()])
    return lm.Network.started(np.bincount(codes, minlength=lm.CLASSES).astype(float), 0), window, target


def test_steps_are_those_of_the_plain_formulas():
    for n in (1, 511, 513, 2048, 7001):  # parts of a piece, of a step, and several steps
        net, window, target = some(n)
        got = net.trained(window, target, 0.05)
        for value, want in zip((got.context, got.hidden_bias, got.out, got.bias), plainly(net, window, target, 0.05), strict=True):
            assert np.allclose(value, want, rtol=1e-3, atol=1e-4)


def test_a_step_holds_few_predictions_at_a_time():
    net, window, target = some(20_000)
    tracemalloc.start()
    net.trained(window, target, 0.05)
    net.log_probability(window, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_500_000  # the predictions of one step are 2 MB, of which three copies were held


def test_large_parameters_stay_finite():
    net, window, target = some(5000)
    wild = lm.Network(net.context * 1000, net.hidden_bias, np.sign(net.out) * 3, np.where(net.bias < -4, -20, 20).astype(np.float32))
    assert np.isfinite(wild.trained(window, target, 5.0).flat()).all()
    assert np.isfinite(wild.log_probability(window, target)).all()


def test_words_are_the_same_by_both_patterns():
    assert lm.words_of(None) == []
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, range(128))), *(f"a{chr(c)}b {chr(c)}{chr(c)}9_" for c in range(128)), "a".join(every), "É! x_1", "İKK straße"]
    for text in texts:
        assert lm.words_of(text) == re.findall(r"\w+|[^\w\s]", text.lower())
