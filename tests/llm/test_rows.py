"""Operators that judge every row by itself: quality figures, tokens, personal data, leaks, licenses."""

import random
import re
import time
from collections import Counter

import brute
import duckdb
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowloom.llm import decontaminate, license_scan, pii, quality_rules, token_counts
from flowloom.llm.queries import ORACLES, QUERIES

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def by_text(df, docs, *columns):
    """[(text, values)] of a result that keeps one row per document, by doc_id."""
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    rows = df.collect()
    assert len(rows) == sum(texts.values())
    known = {i: t for i, t in texts if i is not None}
    return [(known[r.doc_id], tuple(r[c] for c in columns)) for r in rows if r.doc_id is not None]


# ---- quality rules


def test_quality_figures(odd):
    found = quality_rules.quality_rules(odd)
    for text, got in by_text(found, odd, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        assert got == brute.quality(text), text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n#\t", max_size=80))
def test_quality_figures_on_any_text(text):
    assert quality_rules.base_figures(text.encode()) == brute.quality(text)


def line(k):
    return " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + j)}" for j in range(8))


def test_shared_lines_go_but_copies_stay(make):
    """A line on 40 pages of one host goes there and nowhere else; 60 near copies keep theirs."""
    page = [(k, f"{line(0)}\n{line(k + 1)}\n{line(k + 500)}", "en", "a") for k in range(40)]
    thin = [(100, f"{line(0)}\nrest", "en", "a")]
    other = [(101, f"{line(0)}\n{line(60)}", "en", "b")]
    body = [line(k) for k in range(700, 712)]
    changed = [" ".join([f"x{k}" if j == k % 8 else w for j, w in enumerate(body[k % 12].split())]) for k in range(60)]
    copies = [(200 + k, "\n".join([*body[: k % 12], changed[k], *body[k % 12 + 1 :]]), "en", "a") for k in range(60)]
    exact = [(300 + k, f"{line(900)}\n{line(901)}", "en", "a") for k in range(50)]
    docs = make([*page, *thin, *other, *copies, *exact])
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert {i for i, r in found.items() if r.removed_words} == set(range(40)) | {100}
    assert {i for i, r in found.items() if not r.kept} == {100}
    kept = {r.doc_id: r for r in quality_rules.clean(docs).collect()}
    assert set(kept) == set(found) - {100}
    assert kept[3].text == f"{line(4)}\n{line(503)}" and kept[3].n_chars == len(kept[3].text)
    assert kept[101].text == f"{line(0)}\n{line(60)}" and kept[101].asDict().keys() == set(docs.columns)


@pytest.mark.parametrize("shared, own", [(1, 3), (2, 1), (3, 1), (5, 3), (8, 2), (20, 2), (20, 3), (2, 20), (12, 1), (30, 1), (100, 1)])
def test_boilerplate_of_several_lines_goes(make, shared, own):
    """Every shared line of 30 different documents goes, however many stand together and however few are their own."""
    texts = ["\n".join([*(line(j) for j in range(shared)), *(line(max(30, shared) + 4 + own * k + j) for j in range(own))]) for k in range(30)]
    found = quality_rules.quality_rules(make([(k, t, "en", "a") for k, t in enumerate(texts)])).collect()
    assert {r.removed_words for r in found} == {8 * shared}
    copied = quality_rules.quality_rules(make([(k, t, "en", "a") for k, t in enumerate([texts[0]] * 60)])).collect()
    assert {r.removed_words for r in copied} == {0}


def test_a_pool_of_lines_goes_and_near_copies_stay(make):
    """Different texts made of six of ten lines lose them; 1,000 near copies of one page count once."""
    rng = random.Random(31)
    pool = ["\n".join(line(j) for j in sorted(rng.sample(range(10), 6))) for _ in range(400)]
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    page = [" ".join(word() for _ in range(20)) for _ in range(15)]
    copies = []
    for _ in range(1000):
        words = [x.split() for x in page]
        for _ in range(3):
            words[rng.randrange(15)][rng.randrange(20)] = word()
        copies.append("\n".join(" ".join(w) for w in words))
    docs = make([(k, t, "en", "a") for k, t in enumerate(pool + copies)])
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert {found[k].removed_words for k in range(400)} == {48} and not any(found[k].kept for k in range(400))
    assert sum(found[k].removed_words == 0 for k in range(400, 1400)) == 1000


def test_boilerplate_of_small_and_hot_hosts(make):
    """The same line on 12 documents goes from a small host and from one with 2,000 more rows, copies among them."""
    rows = [(k, f"{line(0)}\n{line(k + 1)}", "en", host) for host in ("small", "hot") for k in range(12)]
    rows += [(k, f"{line(100)}\n{line(101)}" if k % 2 else f"text {k}", "en", "hot") for k in range(100, 2100)]
    found = quality_rules.quality_rules(make(rows)).collect()
    assert sum(r.removed_words == 8 for r in found) == 24 and sum(r.removed_words == 0 for r in found) == 2000


def test_near_copies_with_a_changed_word_stay(make):
    """60 near copies of a page of six lines, with a word of one line changed, are one document."""
    body = [line(k) for k in range(6)]
    texts = []
    for k in range(60):
        words = body[k % 6].split()
        words[k % 8] = f"x{chr(97 + k % 26)}{chr(97 + k // 26)}"
        texts.append("\n".join([*body[: k % 6], " ".join(words), *body[k % 6 + 1 :]]))
    found = quality_rules.quality_rules(make([(k, t, "en", "a") for k, t in enumerate(texts)])).collect()
    assert {r.removed_words for r in found} == {0}


def test_quality_of_repeated_and_empty_tables(make, nothing):
    rows = [(1, line(1) + " more words", "en", None)] * 3
    assert quality_rules.clean(make(rows)).count() == 3
    assert quality_rules.quality_rules(nothing).count() == quality_rules.clean(nothing).count() == 0


# ---- token counts


def test_token_counts(odd):
    whole = Tokenizer.from_file(BYTE_BPE)
    for text, (size, tokens, over) in by_text(token_counts.token_counts(odd, BYTE_BPE), odd, "n_bytes", "n_tokens", "over_limit"):
        expected = len(whole.encode(text or "", add_special_tokens=False))
        assert (size, tokens, over) == (len((text or "").encode()), expected, expected > 512), text


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    whole = Tokenizer.from_file(BYTE_BPE)
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 7)
    monkeypatch.setattr(token_counts, "CALL_BYTES", 20)
    texts = ["It's  a   test, über  alles 12 34 a b c d ", "one two three four five", "日本 語 a b c d e f g h", "x" * 50]
    assert [len(list(token_counts.pieces(t))) > 1 for t in texts] == [True, True, True, False]
    assert token_counts.count_batch(texts, BYTE_BPE) == [len(e) for e in whole.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]), st.sampled_from("abc  \n'slé")), max_size=60))
def test_token_counts_of_any_text(text):
    whole = token_counts.encoders(BYTE_BPE)[0]
    assert token_counts.count_batch([text], BYTE_BPE) == [len(whole.encode(text, add_special_tokens=False))]


def test_no_tokens(nothing):
    assert token_counts.token_counts(nothing, BYTE_BPE).count() == 0


# ---- personal data


def test_personal_data(odd, nothing):
    for text, (digest, spans) in by_text(pii.personal_data(odd), odd, "base_sha256", "spans"):
        assert pii.listed(pii.base_spans(text or "")) == ",".join(brute.personal(text))
        assert len(digest) == 64 and set(brute.personal(text)) <= set(spans.split(",")) | {""}
    assert pii.personal_data(nothing).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1234567890.@+-() \n", max_size=60))
def test_base_spans_of_any_text(text):
    assert pii.listed(pii.base_spans(text)) == ",".join(brute.personal(text))
    base, every = pii.find(text)
    assert set(base) <= set(every)


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("write to jane dot doe at mail dot example dot com now", "email", "jane dot doe at mail dot example dot com"),
        ("ask jane [at] mail (dot) example {dot} org please", "email", "jane [at] mail (dot) example {dot} org"),
        ("ask jаne@exаmple.com please", "email", "jаne@exаmple.com"),
        ("ask ja​ne@exam‍ple.com please", "email", "ja​ne@exam‍ple.com"),
        ("card ４１１１ １１１１ １１１１ １１１１ expires", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("call plus one four four four five five five one two one two now", "phone", "plus one four four four five five five one two one two"),
        ("host one two seven dot zero dot zero dot one is home", "ip", "one two seven dot zero dot zero dot one"),
    ],
)
def test_disguises_are_mapped_back(text, kind, source):
    base, every = pii.find(text)
    assert base == []
    assert [(k, text[a:b]) for k, a, b in every] == [(kind, source)]


@pytest.mark.parametrize(
    "text, masked",
    [
        ("ask john [at] example dot com now", "ask [email] now"),
        ("ask john at example (dot) com now", "ask [email] now"),
        ("ask jane dot doe (at) mail [dot] example dot org now", "ask [email] now"),
        ("ask john@example dot com now", "ask [email] now"),
        ("ask john [dot] smith@example.com now", "ask [email] now"),
        ("ask john [dot] smith at example dot com now", "ask [email] now"),
        ("call +1 444 555 498４ now", "call [phone] now"),
        ("look at example.com and a@b.org now", "look at example.com and [email] now"),
    ],
)
def test_mixed_disguises_are_found_and_masked_whole(text, masked):
    base, every = pii.find(text)
    assert set(base) <= set(every) and pii.redact(text, every) == masked


def test_mixed_signs_are_linear_on_long_runs():
    for text in ["a dot " * 50_000, "a at " * 50_000, "a (dot) " * 40_000, "a at b dot " * 30_000, "a@b dot " * 30_000]:
        pii.find(text)


def test_a_run_of_known_endings_is_linear():
    text = "x@a" + " dot com" * 200_000
    start = time.perf_counter()
    _, every = pii.find(text)
    assert every == [("email", 0, len(text))] and time.perf_counter() - start < 10


def test_prose_stays_clean():
    for text in ["We met at noon and one two three went home.", "look at this dot matrix printer", "un deux trois", "at dot at dot"]:
        assert pii.find(text) == ([], [])


def test_spans_are_linear_on_long_runs():
    for text in ["1" * 200_000, "a." * 100_000, "@" * 100_000, "+1 " * 60_000, "1." * 100_000, "one " * 50_000]:
        pii.find(text)


def test_masked_text(make):
    docs = make(["mail a.b@c.org or +1 (444) 555-4984.", None, "clean"])
    got = {r.doc_id: r for r in pii.clean(docs).collect()}
    assert got[0].text == "mail [email] or [phone]." and got[0].n_chars == 24 and got[1].text is None and got[2].text == "clean"


# ---- benchmark leaks

ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again today"), (10, "Short item."), (2, "  "), (3, None), (10, "a b c d e f g h i j k"), (None, "a")]


def test_leaks(spark, odd, make, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = ["Quick, brown fox jumps over the lazy dog again and AGAIN! then short item", "lazy dog", "short-item short item", "A b c d e f g h i j k l"]
    for docs in (odd, make(texts)):
        found = decontaminate.contamination(docs, items)
        real = [(i, t) for i, t in ITEMS if i is not None]
        for text, (n, hit, ids, spans) in by_text(found, docs, "n_words", "n_hit", "hit_items", "hit_spans"):
            assert (n, hit, list(ids)) == brute.leaks(text, real)[:3]
            covered = [w for a, b in spans for w in brute.plain_words(text[a:b])]
            assert len(covered) == hit
    got = [r.doc_id for r in decontaminate.clean(make(texts), items).collect()]
    assert got == [1]
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.contamination(make(texts), items.limit(0)).filter("contaminated").count() == 0


def test_blocks_give_the_same(spark, make):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert len(list(decontaminate.blocks(items, most=5))) > 1 == len(list(decontaminate.blocks(items)))


# ---- licenses


def test_license_places(odd, nothing):
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    for text, got in by_text(license_scan.license_scan(odd), odd, *columns):
        own = brute.plain_words(text)
        places = [
            (at, label)
            for phrase, label in license_scan.PHRASES
            for at in range(len(own))
            if own[at : at + len(phrase.split())] == phrase.split()
        ]
        starts = [at for at, _ in places]
        labels = ",".join(sorted({label for _, label in places}))
        assert got == (len(own), len(places), min(starts, default=None), max(starts, default=None), labels), text
    assert license_scan.license_scan(nothing).count() == 0


def test_license_text_with_changes(make):
    whole = license_scan.TEMPLATES[4][1].split()
    changed = " ".join(w for k, w in enumerate(whole) if k not in (17, 33))
    docs = make([f"Before it {changed} after", " ".join(whole[:12]), f"{' '.join(whole[:25])} {'other ' * 60} {' '.join(whole[25:])}", "no notice at all"])
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert [got[k].labels for k in range(4)] == ["mit", "", "", ""]
    assert 0.8 <= got[0].score < 1 and 0 < got[1].score < 0.8 and got[3].score == 0


def test_every_template_gets_its_own_label_only(make):
    """Also with a word left out, and with a word of another license put in."""
    texts = [text for _, text in license_scan.TEMPLATES]
    wants = [label for label, _ in license_scan.TEMPLATES]
    other = {
        texts[1].replace("general public", "lesser general public").replace("version 3", "version 3 0"): "lgpl",
        texts[3].replace("library", "program") + " either version 3 of the license or at your option any later version": "lgpl",
        texts[1].replace("version 3", "version 4"): "",
        texts[13].replace("sharealike", "noderivatives"): "",
        f"{texts[2]} {'other ' * 20} {texts[1]}": "gpl-2,gpl-3",
        f"{texts[12]} {texts[14]}": "cc-by,cc-by-nc",
    }
    got = {r.doc_id: r.labels for r in license_scan.license_scan(make([f"some words before {t} and after" for t in [*texts, *other]])).collect()}
    assert [got[k] for k in range(len(got))] == [*wants, *other.values()]


def test_phrases_need_enough_words():
    with pytest.raises(ValueError):
        license_scan.template_rows([("two words", "x")], [])
    assert re.match("gpl", license_scan.TEMPLATES[0][0])


# ---- SQL of rules that the given tables hardly exercise


def same_as_sql(spark, name, rows, folder):
    """The query and its SQL on documents (text, source)."""
    from oracle import difference

    columns = {"doc_id": [*range(len(rows))], "text": [t for t, _ in rows], "lang": ["en"] * len(rows), "source": [s for _, s in rows], "n_chars": [0] * len(rows)}
    pq.write_table(pa.table(columns), f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return difference(QUERIES[name](spark, str(folder)).toPandas(), con.sql(ORACLES[name]).df())


def test_altered_license_texts_equal_the_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                at, how = rng.randrange(len(words)), rng.random()
                if how < 0.4:
                    words[at] = rng.choice(["lesser", "noncommercial", "sharealike", "2", "3", "library", "non commercial", "version 9"])
                elif how < 0.7:
                    words.insert(at, rng.choice(["the", "nc", "x"]))
                else:
                    del words[at]
            parts.append(" ".join(words))
        rows.append((" ".join(parts), "s"))
    assert same_as_sql(spark, "op6_license_scan", rows, tmp_path) is None


def test_shared_and_changed_lines_equal_the_sql(spark, tmp_path):
    rng = random.Random(4)
    pool = [" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 24))) for _ in range(40)]
    rows = []
    for k in range(700):
        lines = rng.choices(pool[:12] if k % 3 else pool, k=rng.randint(1, 6)) + [f"own {k} line of a text"] * (k % 2)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(lines))
            words = lines[at].split()
            words[rng.randrange(len(words))] = rng.choice(["X", "y1", "zz", ""])
            lines[at] = " ".join(words)
        rows.append(("\n".join(lines), rng.choice(["a", "a", "b", None])))
    assert same_as_sql(spark, "op1_quality_rules", rows + rows[:40] + [(None, None), ("", "a")], tmp_path) is None
