"""Operators with statistics or groups over all documents."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowloom.llm import components, language_id, packing, simhash, toxicity, url_filters

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

# ---- near duplicates


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def dense(seed, n, flips):
    """Fingerprints around one centre, with chains."""
    rng = random.Random(seed)
    out, p = set(), rng.getrandbits(64)
    for _ in range(n):
        q = p
        for _ in range(rng.randint(0, flips)):
            q ^= 1 << rng.randrange(64)
        out.add(q)
        if rng.random() < 0.1:
            p = q
    return out


@pytest.mark.parametrize("prints", [dense(1, 300, 3), dense(2, 60, 6) | dense(3, 60, 1), {random.Random(4).getrandbits(64) for _ in range(200)}, {0}, {0, 3, 7, (1 << 64) - 1}], ids=range(5))
def test_links_connect_what_all_pairs_connect(spark, prints):
    table = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    groups = simhash.groups(table, table.print)
    got = {r.print: r.component for r in groups.collect()}
    expected = brute.grouped(prints)
    least = defaultdict(list)
    for p, root in expected.items():
        least[root].append(signed(p))
    assert got == {signed(p): min(least[root]) for p, root in expected.items()}


def test_every_link_shares_a_key():
    """Pigeonhole: two prints at most two bits apart agree within the threshold in some partition."""
    rng = random.Random(5)
    correlated = [rng.getrandbits(16) * 0x0001000100010001 & (1 << 64) - 1 for _ in range(500)]
    for sample in (np.array(correlated, np.uint64), np.array([rng.getrandbits(64) for _ in range(500)], np.uint64), np.zeros(0, np.uint64)):
        for total in (10, 10**6, 10**11):
            parts = simhash.plan(np.unique(sample), total)
            for _ in range(300):
                a = rng.getrandbits(64)
                b = a ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
                assert any(((a ^ b) & mask).bit_count() <= t for mask, t in parts)


def test_thresholds_are_the_cheapest():
    rng = random.Random(6)
    costs = [[0.0, rng.random(), 1 + rng.random()] for _ in range(4)]
    cost, chosen = simhash.allocate(costs, -1)
    every = [(sum(c[t + 1] for c, t in zip(costs, ts, strict=True)), list(ts)) for ts in np.ndindex(3, 3, 3, 3) for ts in [[t - 1 for t in ts]] if sum(ts) == -1]
    assert sum(chosen) == -1 and cost == pytest.approx(min(every)[0])


def near_texts():
    rng = random.Random(7)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    out = []
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(400)] = f"x{rng.randrange(99)}"
        out.append(" ".join(copy))
    return out + [" ".join(base)] * 5 + [" ".join(f"w{rng.randrange(3000)}" for _ in range(50)) for _ in range(20)] + ["Same Case", "same\tcase"]


@pytest.mark.parametrize("kind", ["odd", "near"])
def test_near_duplicates(kind, odd, make, nothing):
    docs = odd if kind == "odd" else make(near_texts())
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {t: brute.fingerprint(t) for _, t in texts}
    roots = brute.grouped(set(prints.values()))
    least = {}
    for i, t in texts:
        root = roots[prints[t]]
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter((i, f"{prints[t]:016x}", least[roots[prints[t]]]) for i, t in texts)
    first = [r.doc_id for r in simhash.first_of_groups(docs).collect()]
    assert sorted(first, key=str) == sorted(least.values(), key=str)
    assert simhash.near_duplicates(nothing).count() == simhash.first_of_groups(nothing).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, k) for k in range(1001, 1100)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (7, 6), (2000, 1999)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1100)} | {1999: 1999, 2000: 1999}
    assert components.components(edges.limit(0)).count() == 0


# ---- packing


def check_packing(rows, texts, capacity):
    """Every document's pieces in order and whole, every sequence gapless and within the capacity."""
    whole = Tokenizer.from_file(WORD_BPE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, a, min(capacity, len(ids) - a)) for k, a in enumerate(range(0, len(ids), capacity))]
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()), text
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing(odd, nothing):
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.best_fit_packing(docs, WORD_BPE).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 4096)
    assert packing.best_fit_packing(nothing, WORD_BPE).count() == 0


def test_packing_cuts_long_documents_and_repeated_rows(make):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    rows = packing.best_fit_packing(make(texts), WORD_BPE, capacity=64, ids=True).collect()
    check_packing(rows, dict(enumerate(texts)), 64)
    assert all(len(r.ids) == r.length for r in rows)
    twice = packing.best_fit_packing(make([(1, "a b", "en", "s")] * 3), WORD_BPE).collect()
    assert [(r.sequence_id, r.offset) for r in sorted(twice, key=lambda r: r.offset)] == [(0, 0), (0, 3), (0, 6)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 400), max_size=40), st.integers(1, 12))
def test_bins_hold_all_pieces(counts, groups):
    classes = packing.pack(counts, 100, 1 / 8, (groups,))
    held = Counter()
    for content, bins in classes:
        assert sum(content) <= 100 and bins > 0
        for length in content:
            held[length] += bins
    assert held == counts
    places = set()
    runs = packing.slots(classes)
    for length, n in counts.items():
        firsts = [r[0] for r in runs[length]]
        for number in range(min(n, 50)):
            sequence, offset = packing.place(runs[length], firsts, length, number)
            assert (sequence, offset) not in places and offset + length <= 100
            places.add((sequence, offset))


def test_few_sequences():
    rng = np.random.default_rng(9)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1.1, 60_000).astype(int) + 1)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    bins = sum(n for _, n in packing.pack(counts))
    assert bins <= 1.0005 * lengths.sum() / 4096 + 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), st.sampled_from("ab 'sltÀß́<|>")), max_size=50))
def test_ids_of_any_text(text):
    encode = packing.word_ids(WORD_BPE)
    assert np.frombuffer(encode(text.encode()), "<u4").tolist() == encode.whole.encode(text, add_special_tokens=False).ids


def test_ids_of_a_batch_are_those_of_single_words(monkeypatch):
    rng = random.Random(14)
    texts = [" ".join("".join(rng.choices("abcé'12<|>ß日.,S ", k=rng.randint(1, 9))) for _ in range(60)).encode() for _ in range(80)]
    monkeypatch.setattr(packing, "CALL_WORDS", 50)
    encode = packing.WordIds(WORD_BPE)
    got = encode.batch(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encode.whole.encode(text.decode(), add_special_tokens=False).ids


# ---- toxicity


def sentences(rng, n, extra=()):
    vowels, others = "aeiou", "bdfgklmnprst"
    own = ["".join(rng.choice(others) + rng.choice(vowels) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for w in extra:
        own.insert(rng.randrange(n), w)
    return " ".join(own)


def test_toxicity(spark, make, odd, nothing):
    rng = random.Random(10)
    bad = ["worthless", "idiot", "pathetic", "scum", "moron"]
    texts, labels = [], []
    for k in range(900):
        toxic = k % 6 == 0
        texts.append(sentences(rng, rng.randint(20, 80), rng.choices(bad, k=3) if toxic else ()))
        labels.append((k, int(toxic)))
    table = spark.createDataFrame([*labels, (None, 1), (5, None), (3, 0), (99999, 1)], "doc_id long, toxic int")
    docs = make(texts)
    found = {r.doc_id: r for r in toxicity.toxicity(docs, table).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert {k for k, r in found.items() if r.held_out} == set(held)
    right = sum(found[k].predicted == labels[k][1] for k in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    # held-out labels teach nothing
    flipped = spark.createDataFrame([(k, 1 - y if k in set(held) else y) for k, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {k: r.score for k, r in found.items()}
    assert toxicity.toxicity(odd, table).count() == odd.count()
    assert {r.score for r in toxicity.toxicity(odd, table.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(nothing, table).count() == 0


# ---- language


def plain_length(text, grams, symbols=256, order=3):
    """Code length by the definition: longest seen context first, escapes of method C below."""
    stream = [32] * order + [*text]
    bits = 0.0
    for k in range(order, len(stream)):
        for size in range(order, -2, -1):
            if size < 0:
                bits += np.log2(symbols)
                break
            after = grams[size].get(tuple(stream[k - size : k]))
            if not after:
                continue
            n, kinds = sum(after.values()), len(after)
            if stream[k] in after:
                bits += np.log2((n + kinds) / after[stream[k]])
                break
            bits += np.log2((n + kinds) / kinds)
    return bits


def test_code_lengths(spark):
    texts = {"de": ["Die Straße ist grün", "über Äpfel"], "en": ["the cat sat", "on the mat 12"], "zz": [""]}
    rows = [(lang, t.encode()) for lang, own in texts.items() for t in own]
    (model,) = language_id.models(spark.createDataFrame(rows, "lang string, text binary"))
    assert model.langs == ["de", "en"]
    probes = [b"the mat", "grüße".encode(), b"", b"zzzz qqq", b"Die Katze", bytes(range(256)), "日本 Straße".encode()]
    got = model.lengths(probes)
    for k, lang in enumerate(model.langs):
        grams = [defaultdict(Counter) for _ in range(4)]
        for t in texts[lang]:
            s = [32, 32, 32, *t.encode()]
            for at in range(3, len(s)):
                for size in range(4):
                    grams[size][tuple(s[at - size : at])][s[at]] += 1
        assert got[:, k] == pytest.approx([plain_length(p, grams) for p in probes], rel=1e-5)


def test_strings_of_high_counts_are_kept(spark):
    rng = random.Random(15)
    rows = [(f"{lang}", f"{lang} {rng.randrange(10**6)} common words".encode()) for lang in ("a", "b") for _ in range(300)]
    table = spark.createDataFrame(rows, "lang string, text binary")
    (whole,) = language_id.models(table)
    (small,) = language_id.models(table, most=60)
    assert len(small.four.keys) <= 120 < len(whole.four.keys) and set(small.four.keys) < set(whole.four.keys)
    assert np.frombuffer(b"comm", ">u4")[0] in small.four.keys


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**32 - 1), max_size=300), st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_index_finds_its_keys(keys, others):
    known = np.array(sorted(keys), np.uint32)
    index = language_id.Index(known)
    asked = np.array([*keys, *others], np.uint32)
    assert [int(known[r]) if r >= 0 else None for r in index.find(asked)] == [k if k in keys else None for k in asked.tolist()]


def test_language_id(make, odd, nothing):
    rng = random.Random(11)
    parts = {"en": ["the", "and", "ing", "tion", "er"], "fr": ["le", "eau", "tion", "é", "oi"], "de": ["der", "sch", "ung", "ü", "ei"]}
    rows = []
    for k in range(300):
        lang = rng.choice([*parts])
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(2, 40)))
        rows.append((k, text, lang if k % 10 else None, None))
    langs = {k: lang for k, _, lang, _ in rows}
    found = {r.doc_id: r for r in language_id.language_id(make(rows)).collect()}
    held = [k for k in langs if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in found.items() if r.held_out} == set(held)
    assert sum(found[k].lang_pred == langs[k] for k in held if langs[k]) >= 0.95 * sum(langs[k] is not None for k in held)
    blocks = {r.doc_id: r for r in language_id.language_id(make(rows), langs=2).collect()}  # two passes
    assert all(blocks[k].lang_pred == r.lang_pred and blocks[k].score == pytest.approx(r.score, abs=1e-9) for k, r in found.items())
    got = {r.doc_id: r for r in language_id.language_id(odd).collect()}
    texts = {r.doc_id: r.text for r in odd.collect()}
    for k, r in got.items():
        letters = texts[k] is not None and any(c.isalpha() for c in texts[k])
        assert r.lang_pred == ("en" if letters else "und") and 0 <= r.score <= 1
    assert {r.lang_pred for r in language_id.language_id(make([(1, "text", None, None)])).collect()} == {"und"}
    assert language_id.language_id(nothing).count() == 0


# ---- urls


def judged(spark, urls, outcomes, **how):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    bad = spark.createDataFrame(outcomes, "page_id long, bad int")
    return {r.page_id: r for r in url_filters.url_filters(pages, bad, how=url_filters.Reputation(**how)).collect()}


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "https://a.example.com/en/", "https://example.com/en", "x://net/fr/1", "x://badnet/fr/1",
        "http://a.net?/es/", "http://b.net/es/#x", "http://com", "a://b://c/d", "http://É.com/é", "http://sub.www.example.com/en/?x=/y",
    ]
    got = judged(spark, urls, [])
    expected = [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/", "example.com/en/", "block"), ("example.com", "/en", "com/", "allow"), ("net", "/fr/1", "net/fr/", "block"), ("badnet", "/fr/1", None, "allow"),
        ("a.net", "", None, "allow"), ("b.net", "/es/", "net/es/", "block"), ("com", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("É.com", "/é", "com/", "allow"),
        ("sub.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ]
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(len(urls))] == expected


def test_reputation_blocks_bad_hosts_only(spark):
    urls = [f"http://spam.site.org/{k}" for k in range(60)] + [f"http://new.site.org/{k}" for k in range(2)] + [f"http://h{k % 20}.fine.org/{k}" for k in range(200)]
    outcomes = [(k, 1) for k in range(50)] + [(60, 1)] + [(k, int(k % 7 == 0)) for k in range(62, 262)] + [(0, 0), (None, 1), (70, None), (9999, 1)]
    got = judged(spark, urls, outcomes)
    assert {got[k].verdict for k in range(60)} == {"block"}
    assert {got[k].verdict for k in range(62, 262)} == {"allow"}
    assert got[61].host_bad_rate > got[100].host_bad_rate  # a new host leans on its domain
    assert judged(spark, urls[:0], outcomes) == {}
