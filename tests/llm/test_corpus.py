"""Packing, mixing and wrongly decoded text."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from cairn.llm import mixing, mojibake, packing, tokens


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in bins if r >= s]
        bins.append((min(fit) if fit else capacity) - s)
        if fit:
            bins.remove(min(fit))
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_planned_packing_is_best_fit_decreasing(sizes, capacity):
    runs, opened = packing.best_fit_decreasing(dict(Counter(sizes)), capacity)
    fill, ranks = Counter(), defaultdict(list)
    for r in runs:
        for k in range(r.n):
            fill[r.container + k // r.each] += r.size
            ranks[r.size].append(r.first + k)
    assert {s: sorted(v) for s, v in ranks.items()} == {s: list(range(n)) for s, n in Counter(sizes).items()}
    assert sorted(capacity - fill[b] for b in range(opened)) == plain_best_fit(sizes, capacity)


def test_pack_splits_only_what_is_too_large(spark):
    rng = random.Random(1)
    sizes = [(k, rng.randrange(0, 90)) for k in range(2000)] + [(5000, 250), (5001, 100), (5002, 0), (5002, 0), (None, 4), (5003, None), (5004, -1)] + [(6000 + k, 30) for k in range(1500)]
    rows = packing.pack(spark.createDataFrame(sizes, "id long, size int"), 100, part_rows=40).collect()
    fill = Counter()
    for r in rows:
        fill[r["container"]] += r["size"]
    assert max(fill.values()) <= 100
    kept = [(i, s) for i, s in sizes if i is not None and s is not None and s >= 0]
    assert sum(r["size"] for r in rows) == sum(s for _, s in kept)
    whole = [s for _, s in kept if s]
    parts = [p for s in whole for p in [100] * ((s - 1) // 100) + [(s - 1) % 100 + 1]]
    assert len([b for b in fill]) == len(plain_best_fit(parts, 100))
    assert sorted((r["piece"], r["start"], r["size"]) for r in rows if r["id"] == 5000) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert len([r for r in rows if r["id"] == 5001]) == 1 and len([r for r in rows if r["id"] == 5002]) == 2
    assert packing.pack(spark.createDataFrame([], "id long, size int"), 100).isEmpty()


def test_documents_are_packed_whole(spark):
    texts = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "wort " * 30000, "x"), (4, "twice", "x")]
    rows = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string, size string")).collect()
    count = lambda t: len(tokens.encoder(tokens.VOCABULARY).encode_ordinary(t or ""))
    assert sum(r["n_tokens"] for r in rows) == sum(count(t) for _, t, _ in texts)
    assert all(r["n_tokens"] <= packing.CAPACITY for r in rows) and {r["doc_id"] for r in rows} == {1, 2, 3, 4}


def test_mix_meets_shares_and_caps(spark):
    rng = random.Random(2)
    docs = [(k, "word " * rng.randrange(1, 60), "big" if k % 3 else "small") for k in range(3000)] + [(9001, None, "big"), (None, "word", "big"), (9002, "word", None), (9003, "word", "other")]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2), ("zero", 0.0, 1)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed = mixing.mix(d, t, shards=4).cache()
    rows = mixed.collect()
    uses = Counter(r["doc_id"] for r in rows)
    source = {k: s for k, _, s in docs}
    assert all(n <= {"big": 1, "small": 3}[source[k]] for k, n in uses.items())
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) and max(uses.values()) > 1
    tokens_of = Counter()
    for r in rows:
        tokens_of[r["source"]] += r["n_tokens"]
    assert abs(tokens_of["big"] / tokens_of["small"] - 0.5 / 0.4) < 0.01
    report = {r["source"]: r for r in mixing.shares(mixed, t).collect()}
    assert set(report) == {"big", "small", "none", "zero"} and report["none"]["tokens"] == 0 and report["small"]["most_uses"] <= 3
    for shard in range(4):
        assert sorted(r["position"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert rows == mixing.mix(d, t, shards=4).collect() or {tuple(r) for r in rows} == {tuple(r) for r in mixing.mix(d, t, shards=4).collect()}
    assert mixing.mix(d.limit(0), t).isEmpty()


def test_shard_quotas_are_exact():
    import numpy as np

    q = mixing.shard_quotas(np.array([100, 7, 0]), 5, np.random.default_rng(1))
    assert q.sum(axis=0).tolist() == [100, 7, 0] and q.sum(axis=1).max() - q.sum(axis=1).min() <= 1


CLEAN = [
    "The café beside the gate opens at 08:35 and keeps a few tables outside.", "Fußgänger müssen den südlichen Übergang nehmen.", "Ortalama hız 40 km/s, olağan hız 50. Şerit daraldı.", "Işıklardan sonra sağa dönün, köprünün altından geçin.",
    "يوجد موقف سيارات خلف كراج يتسع لعدد قليل", "الطريق مغلق بين المدرسة والصيدلية لمدة أيام", "¿Dónde cruzar? Más allá del jardín, señal dañada.", "It’s the “old gate” that people mean — really…", "Parking costs €7 per hour, 88 °C, the detour is ½.",
]
TRAPS = ["Le sigle Ÿ° signifie chaussée étroite.", "The vendor writes “ÃO·BÃO” and “Â-lane”.", "├── lanes │ └── kerbs ╔══╗", "Signs read «Вокзал Норван» and «Парк Суннад».", "Þorvík and “Ýravík, Ðalur”", "plain ascii", "", None]


def corpus():
    rng = random.Random(1)
    return [(k, rng.choice(CLEAN)) for k in range(300)] + [(1000 + k, t) for k, t in enumerate(TRAPS * 4)]


@pytest.mark.parametrize("chain", mojibake.CHAINS[:-1])
def test_garble_and_invert_round_trip(chain):
    done = 0
    for text in CLEAN:
        wrong = mojibake.garble(text, chain)
        if wrong is not None and wrong != text:
            assert mojibake.invert(wrong, chain) == text
            done += 1
    assert done


def test_garbled_documents_are_found_and_restored(spark):
    wrong = {}
    for k, chain in enumerate(mojibake.CHAINS):
        for j, text in enumerate(CLEAN):
            bad = mojibake.garble(text, chain)
            if bad is not None and bad != text:
                wrong[5000 + 100 * k + j] = (bad, text, chain)
    lost = {9990: "Caf� is closed", 9991: "x" * 50_000 + " cafÃ©"}
    rows = corpus() + [(k, b) for k, (b, _, _) in wrong.items()] + list(lost.items())
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, chains string")
    got = {r["doc_id"]: r for r in mojibake.garbled_documents(df).collect()}
    assert not {k for k in got if k < 5000}, [got[k]["restored"] for k in got if k < 5000]
    utf8 = {k for k, (_, _, c) in wrong.items() if c[-1][0] == "utf-8"}
    assert len(utf8 & set(got)) >= 0.97 * len(utf8) and len(set(wrong) & set(got)) >= 0.85 * len(wrong)
    assert set(lost) <= set(got) and not got[9990]["complete"]
    exact = [got[k]["restored"] == wrong[k][1] for k in utf8 & set(got)]
    assert sum(exact) >= 0.9 * len(exact)
    assert mojibake.garbled_documents(df.limit(0)).isEmpty()


def test_every_chain_is_tried_and_the_sample_is_fine_grained(spark, monkeypatch):
    words = {w: 5 for t in CLEAN for w in mojibake._words(t)}
    model, tried = mojibake.train(words), []
    real = mojibake.invert
    monkeypatch.setattr(mojibake, "invert", lambda text, chain: tried.append(chain) or real(text, chain))
    model.judge([mojibake.garble("Fußgänger", mojibake.CHAINS[0])])
    assert set(tried) == set(mojibake.CHAINS)
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    with pytest.raises(ValueError):
        mojibake.trained_on(df, sample=1e-15)


def test_shards_grow_with_the_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "USES_A_SHARD", 20)
    docs = spark.createDataFrame([(k, "word " * 5, "a") for k in range(500)], "doc_id long, text string, source string")
    goals = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, goals)
    assert mixed.count() == 500 and mixed.select("shard").distinct().count() == 25
