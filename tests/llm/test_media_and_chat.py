import hashlib
import random

import numpy as np
import pyarrow as pa
from skymatch.llm import audio, chat
from skymatch.llm.common import materialise


def test_wav_round_trip_and_features(odd, make):
    rows = audio.feature_digest(audio.describe(audio.encode(odd))).collect()
    texts = odd.collect()
    assert len(rows) == len(texts)
    for row, t in zip(rows, texts, strict=True):
        raw = (t["text"] or "").encode()
        held = audio.payload(t["text"])
        assert row["n_bytes"] == len(raw) and row["payload_bytes"] == len(held) and len(held) % 64 == 0 and len(held) > 0
        assert row["payload_sha256"] == hashlib.sha256(held).hexdigest() and held.startswith(raw) and not held[len(raw) :].strip(b"\0")
        assert row["media_sha256"] == hashlib.sha256(audio.wav(held)).hexdigest() and len(row["tensor"]) == audio.SLOTS * audio.MELS
    assert len({r["feature"] for r in rows if r["doc_id"] in (1, 6)}) == 1
    assert audio.describe(audio.encode(make([]))).count() == 0


def test_stored_media_and_tensors_of_fixed_shape(odd):
    media = materialise(audio.encode(odd), "media")
    described = audio.describe(media)
    assert described.schema["tensor"].metadata == {"shape": [audio.SLOTS, audio.MELS]}
    found = described.select("tensor").toArrow()["tensor"]
    held = audio.tensors(found)
    assert held.type == pa.fixed_shape_tensor(pa.float32(), [audio.SLOTS, audio.MELS])
    want = np.stack([audio.describe_samples(audio.samples(r["media"])[1])[0] for r in media.collect()])
    assert np.allclose(held.to_numpy_ndarray(), want, atol=1e-5)


def test_mel_filters_and_slots_equal_plain_sums():
    """Triangles on the mel scale, and means over slots of time, worked out one value at a time."""
    rate = audio.RATE * audio.UP / audio.DOWN
    edge = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), audio.MELS + 2)]
    for k in range(audio.MELS):
        for i in range(0, audio.FRAME // 2 + 1, 7):
            f = i * rate / audio.FRAME
            want = max(0.0, min((f - edge[k]) / (edge[k + 1] - edge[k]), (edge[k + 2] - f) / (edge[k + 2] - edge[k + 1])))
            assert abs(audio.BANK[i, k] - want) < 1e-4
    raw = np.random.default_rng(3).integers(0, 256, 6400).astype("u1").tobytes()
    tensor, _ = audio.describe_samples(raw)
    mels = audio.log_mels(audio.resample((np.frombuffer(raw, "u1").astype("f4") - 128) / 128))
    for s in range(audio.SLOTS):
        rows = [m for i, m in enumerate(mels) if int(s * len(mels) / audio.SLOTS) <= i < int((s + 1) * len(mels) / audio.SLOTS)]
        assert np.allclose(tensor[s], np.mean(rows, axis=0), atol=1e-5)


def test_resampling_equals_the_plain_sum():
    x = np.random.default_rng(0).standard_normal(500).astype("f4")
    got = audio.resample(x)
    lead = audio.TAPS // 2 - audio.DOWN
    padded = np.concatenate([np.zeros(lead), x, np.zeros(100)])
    for k in (0, 1, 2, 3, 100, 371):
        taps = audio.FILTERS.reshape(audio.TAPS, audio.UP)[:, k % audio.UP]
        at = k // audio.UP * audio.DOWN
        assert abs(got[k] - padded[at : at + audio.TAPS] @ taps) < 1e-4
    t = np.arange(4000) / audio.RATE
    tone = audio.resample(np.sin(2 * np.pi * 440 * t).astype("f4"))[50:-50]
    spectrum = np.abs(np.fft.rfft(tone * np.hanning(len(tone))))
    assert abs(spectrum.argmax() * audio.RATE * audio.UP / audio.DOWN / len(tone) - 440) < 5


def test_hysteresis_and_blocks():
    level = np.array([0, 5, 3, 3, 0, 3, 5, 0, 5.0])
    assert audio.hysteresis(level, 2, 4).tolist() == [[1, 4], [6, 7], [8, 9]]
    x = np.random.default_rng(1).standard_normal(audio.HOP * (audio.BLOCK + 10)).astype("f4")
    many = audio.log_mels(x)
    assert np.allclose(many[5000:] if len(many) > 5000 else many[-3:], audio.log_mels(x[(len(many) - 3) * audio.HOP :])[-3:], atol=1e-3)


def slow_digest(rows):
    said = "".join(f"{r}\n{t}\n" for r, t in rows)
    lost = "".join(t for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest()


def test_chat_reads_back_what_was_said(spark):
    r = random.Random(9)
    bits = ["\\", "#", "##", "### assistant: ", "</turn>\n", "<", "\\l", "\\s", ":", " ", "ok", "é", "\n", ""]
    rows, want = [], {}
    for conv in range(30):
        turns = []
        for turn in range(r.randint(1, 6)):
            role = r.choice(["user", "assistant", "system", "tool: x", None])
            text = r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 8)))])
            turns.append((turn, role, text))
        want[conv] = [(a or "", b or "") for _, a, b in turns]
        rows += [(conv, *t) for t in turns]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.digest(chat.conversations(chat.segments(table))).collect()
    for row in got:
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == slow_digest(want[row["conv_id"]])
    assert len(got) == 30


def test_chat_order_blocks_and_state_machine(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", str(t)) for t in range(2 * chat.BLOCK + 3)]
    rows += [(2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "system", "s"), (3, 1, "user", "u"), (4, 0, "assistant", "x"), (None, None, "user", None), (5, 1, "user", "b"), (5, None, "system", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.turns(table, chat.Template()).collect()
    order = {}
    for r in sorted(made, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["number"])):
        order.setdefault(r["conv_id"], []).append((r["number"], r["in_order"], r["text"]))
    assert [n for n, _, _ in order[1]] == list(range(2 * chat.BLOCK + 3)) and [t for _, _, t in order[1]] == [str(t) for t in range(2 * chat.BLOCK + 3)]
    assert all(ok for _, ok, _ in order[1]) and [ok for _, ok, _ in order[2]] == [True, False] and [ok for _, ok, _ in order[3]] == [True, True]
    assert [ok for _, ok, _ in order[4]] == [False] and order[None] == [(0, True, "")] and [t for _, _, t in order[5]] == ["a", "b"]
    pieces = chat.segments(table.where("conv_id = 2")).orderBy("number", "part").collect()
    assert "".join(p["piece"] for p in pieces) == "### user: a</turn>\n### user: b</turn>\n" and not any(p["loss"] for p in pieces)
    assert chat.digest(chat.conversations(chat.segments(table.limit(0)))).count() == 0
