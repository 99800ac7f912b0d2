import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from skymatch.llm import packing
from tokenizers import Tokenizer

NAME = "byte_bpe_50k.json"


def test_plan_keeps_proportions_and_leaves_no_gap():
    r = np.random.default_rng(0)
    total = {"a": 5000, "b": 13_001, "c": 777, "d": 1}
    for targets in (None, {"a": 0.5, "b": 0.3}, {"c": 1.0}):
        plan = packing.Plan(total, targets, 64)
        q, a, b = [], [], []
        for k, name in enumerate(plan.names):
            at = 0
            while at < total[name]:
                n = int(r.integers(1, 400))
                q.append(k), a.append(at), b.append(min(total[name], at + n))
                at += n
        row, start, length, place = plan.cut(np.array(q), np.array(a), np.array(b), 64)
        order = np.argsort(place)
        assert place[order][0] == 0 and (place[order][1:] == (place + length)[order][:-1]).all()
        assert ((place % 64) + length <= 64).all() and length.sum() == sum(total.values())
    served = np.bincount(place[order].repeat(length[order]) // 64, minlength=3)
    assert (served[:-1] == 64).all()
    plan = packing.Plan({"a": 64_000, "b": 64_000}, {"a": 0.75, "b": 0.25}, 64)
    row, start, length, place = plan.cut(np.array([0, 1]), np.array([0, 0]), np.array([64_000, 64_000]), 64)
    share = np.bincount(place[row == 0] // 64, weights=length[row == 0], minlength=2000)[:1300]
    assert abs(share - 48).max() <= 2  # a queue's share of every window, within the fraction it carries


def pieces(plan, totals, size, most=400, seed=1):
    """All queues cut into documents and placed; the stream must have no gap."""
    r = np.random.default_rng(seed)
    q, a, b = [], [], []
    for k, name in enumerate(plan.names):
        at = 0
        while at < totals[name]:
            n = int(r.integers(1, most))
            q.append(k), a.append(at), b.append(min(totals[name], at + n))
            at += n
    q, a, b = map(np.array, (q, a, b))
    row, start, length, place = plan.cut(q, a, b, size)
    order = np.argsort(place)
    assert place[order][0] == 0 and (place[order][1:] == (place + length)[order][:-1]).all() and length.sum() == sum(totals.values())
    assert ((place % size) + length <= size).all()
    return q[row], a[row] + start, length, place


@pytest.mark.parametrize("targets", [None, "some"])
def test_bundles_serve_like_one_plan(targets):
    """Two levels against one: the same tokens, in order within each queue, and near the same place of the stream."""
    r = np.random.default_rng(4)
    totals = {f"s{k:03d}": int(n) for k, n in enumerate(r.pareto(1.0, 60) * 400 + 1)}
    goal = None if targets is None else {k: float(r.integers(0, 5)) for k in totals}
    flat, two = packing.Plan(totals, goal, 128), packing.Bundles(totals, goal, 128)
    assert flat.names == two.names and len(two.inner) > 10
    at = []
    for plan in (flat, two):
        queue, start, length, place = pieces(plan, totals, 128)
        order = np.lexsort((start, queue))
        assert (np.diff(place[order])[np.diff(queue[order]) == 0] > 0).all()
        at.append({(int(q), int(s) + i): int(p) + i for q, s, n, p in zip(queue, start, length, place, strict=True) for i in range(n)})
    assert at[0].keys() == at[1].keys()
    apart = np.array([abs(at[0][t] - at[1][t]) for t in at[0]])
    assert np.median(apart) < (600 if goal is None else 0.1 * len(apart))
    assert isinstance(packing.plan_of(totals, goal, 128), packing.Plan)


def test_twenty_thousand_sources_need_little_memory():
    import pickle
    import tracemalloc

    totals = {f"s{k:05d}": 200 + k % 97 for k in range(20_000)}
    tracemalloc.start()
    plan = packing.plan_of(totals, {k: 1.0 + int(k[1:]) % 7 for k in totals}, 1024)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert len(pickle.dumps(plan)) < 60e6
    some = np.arange(0, 20_000, 400)
    row, start, length, place = plan.cut(some, np.zeros(len(some), "i8"), np.array([totals[plan.names[k]] for k in some]), 1024)
    assert np.bincount(row, weights=length).astype(int).tolist() == [totals[plan.names[k]] for k in some]
    assert place.min() >= 0 and (place + length).max() <= sum(totals.values())


@pytest.mark.parametrize("text", ["a  b   c \n\n d", "  x", "x  ", " \n y\t z", "it's 's don't ’s", "<|endoftext|> a", "日本語 テキスト ok é", "a b  c", "x\x1cy \x1f z", "ſ K é'S", " ", "tab\t\tx \r\n y"])
def test_words_equal_the_tokenizer(text):
    whole = Tokenizer.from_file(public_tokenizers.path(NAME)).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.words_of(NAME).encode(text), "<u2").tolist() == whole


def test_white_space_in_all_arrangements_equals_the_tokenizer():
    signs = " \n\t\r\xa0\u3000\u2003x"
    texts = ["".join(t) for n in range(1, 6) for t in itertools.product(signs, repeat=n)]
    texts += [f"a{t}b" for t in texts if len(t) < 5]
    r = random.Random(3)
    bits = [" ", " ", " ", "  ", "\xa0", "\n", "\x85", "\x1c", "\u200b", "\ufeff", "\u0301", "it's", "Ab", "é", "ſ", "9", "12", "..", "日本", "ö", "€", "'ll", "_", "\u202f"]
    texts += ["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(30_000)]
    words = packing.Words(NAME)
    for k in range(0, len(texts), 20_000):
        some = texts[k : k + 20_000]
        for text, want in zip(some, words.whole.encode_batch(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(words.encode(text), words.kind).tolist() == want.ids, repr(text)


def test_wide_vocabularies_keep_32_bits():
    class Wide(packing.Words):
        def __init__(self, name):
            super().__init__(name)
            self.kind = "<u4"

    wide = Wide(NAME)
    assert np.frombuffer(wide.encode("some  words"), "<u4").tolist() == np.frombuffer(packing.words_of(NAME).encode("some  words"), "<u2").tolist()


def test_pieces_rebuild_every_document(odd, make):
    whole = Tokenizer.from_file(public_tokenizers.path(NAME))
    got = packing.pack(odd, NAME, with_ids=True, size=256).collect()
    want = sorted([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in odd.collect())
    by = defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        by[r["doc_id"]].append(r)
    ids = []
    for rows in by.values():
        rows.sort(key=lambda r: r["start"])
        ids.append([x for r in rows for x in np.frombuffer(r["ids"], "<u4").tolist()])
    assert sum(map(len, ids)) == sum(map(len, want))
    assert sorted(i for i in ids if len(i) > 50) == [w for w in want if len(w) > 50]
    room = defaultdict(list)
    for r in got:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for s, cuts in room.items():
        cuts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(cuts, cuts[1:], strict=False)) and cuts[0][0] == 0
        assert s == max(room) or sum(n for _, n in cuts) == 256
    assert packing.pack(make([]), NAME).count() == 0
