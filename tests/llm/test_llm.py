"""Operators on training data against brute force, with nulls, blanks, ties, repeated rows and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import compare
from conftest import SF
from quire.llm import chat, decontaminate, jaccard, mixing, pii, quality, shards, tokens, urls, warc
from quire.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, sf, name):
    names, got = compare.rows_of(Q.QUERIES[name](spark, sf))
    if name not in Q.SQL:
        assert got
        return
    rel = con.execute(Q.SQL[name])
    cols = [d[0] for d in rel.description]
    order = [cols.index(c) for c in sorted(cols)]
    assert names == sorted(cols)
    assert got == sorted(tuple(compare.plain(r[i]) for i in order) for r in rel.fetchall())


# --- 1 urls


def test_urls_parse_and_rules(spark):
    rows = [(1, "http://A.Example.com/en/x?q"), (2, "https://www.example.com/en/"), (3, "http://x.net/es/1#t"), (4, None), (5, "no scheme"), (6, "http://h.org"), (6, "http://h.org"), (7, "http://com")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    out = collections.defaultdict(list)
    for r in urls.judge(pages, labels, Q.RULES).collect():
        out[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert out[1] == [("a.example.com", "/en/x", "example.com/en/", "block")]
    assert out[2] == [("www.example.com", "/en/", "www.example.com/en/", "allow")]
    assert out[3] == [("x.net", "/es/1", "net/es/", "block")]
    assert out[4] == out[5] == [("", "", None, "allow")]
    assert out[6] == [("h.org", "", None, "allow")] * 2
    assert out[7] == [("com", "", None, "allow")]


def test_bad_hosts_are_blocked_and_shrinkage_spares_the_unknown(spark, monkeypatch):
    rows, bad = [], []
    for h in range(12):
        for k in range(40):
            rows.append((len(rows), f"http://h{h}.d{h % 4}.org/p{k}"))
            bad.append((len(bad), int(h == 3 or (k == 0 and h > 6))))
    rows.append((len(rows), "http://new.d1.org/"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(bad, "page_id long, bad int")
    want = {r.page_id: r.verdict for r in urls.judge(pages, labels, []).collect()}
    assert {i // 40 for i, v in want.items() if v == "block"} == {3}
    monkeypatch.setattr(urls, "BROADCAST_HOSTS", 0)
    assert {r.page_id: r.verdict for r in urls.judge(pages, labels, []).collect()} == want


# --- 2 decontamination


def brute_hits(text, items, window=10):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    w, hit, found = rx.findall(low(text)), set(), set()
    for key, item in items:
        v = rx.findall(low(item))
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n)), found.add(key)
    return len(w), len(hit), sorted(found)


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_automaton_equals_brute_force(data):
    word = st.sampled_from(["a", "b", "c", "É", "d1"])
    text = st.lists(word, max_size=40).map(" ".join)
    items = [(str(i), t) for i, t in enumerate(data.draw(st.lists(text, max_size=4)))]
    window = data.draw(st.integers(1, 5))
    sam, doc = decontaminate.Automaton(items, window), data.draw(text)
    words = decontaminate.words_of(doc.encode())
    spans, found = sam.match(words)
    assert (len(words), sum(b - a for a, b in spans), sam.named(found)) == brute_hits(doc, items, window)


def test_decontamination_of_edges_and_cleaning(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "short one"), (None, "x y z")], "item_id long, text string")
    sam = decontaminate.build(spark, bench)
    d = docs(spark, [None, "", f"before {item.upper()}, after " + "tail " * 60, item, "a short-one b", "clean text"])
    out = {r.doc_id: r for r in decontaminate.digest(d.withColumn("items", F.lit(1)), sam).collect()}
    assert (out[0].n_words, out[1].n_words) == (0, 0)
    assert out[2].n_hit == 12 and out[2]["items"] == ["1"] and out[4]["items"] == ["3"]
    kept = {r.doc_id: r for r in decontaminate.clean(d, sam).collect()}
    assert set(kept) == {0, 1, 2, 5} and kept[5].text == "clean text"
    assert kept[2].text.startswith("before , after") and kept[2].n_chars == len(kept[2].text)


def test_benchmark_in_parts_equals_the_whole(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(4, 30)))) for i in range(12)] + [(None, "q r s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [None, "", "q r s t"] + [f"{t[1][:40]} pad pad {rng.choice(items)[1]} " + "tail " * rng.randrange(200) for t in items]
    d = docs(spark, texts).withColumn("k", F.lit(1)).withColumn("row", F.lit(2))
    whole = decontaminate.build(spark, bench)
    want, kept = sorted(map(tuple, decontaminate.digest(d, whole).collect()), key=str), sorted(map(tuple, decontaminate.clean(d, whole).collect()), key=str)
    assert whole.parts == 1 and any(r[2] for r in want)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 60)
    parts = decontaminate.build(spark, bench)
    assert parts.parts > 2
    assert sorted(map(tuple, decontaminate.digest(d, parts).collect()), key=str) == want
    assert sorted(map(tuple, decontaminate.clean(d, parts).collect()), key=str) == kept
    for r in want:
        assert r[1:3] == brute_hits(texts[r[0]], [(str(k), t) for k, t in items])[:2]


# --- 3 WARC


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 50
    rows = [(5, "http://a/\r\nX: 1", big), (2, "http://b/", big), (7, None, big), (3, "u", "x"), (4, "u", "x"), (9, "u", None), (10, "u", ""), (11, "u", "a\r\n\r\nb" * 40)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        p = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(p), hashlib.sha256(p).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {5: ("revisit", 2), 2: ("response", None), 7: ("revisit", 2), 3: ("response", None), 4: ("response", None), 9: ("response", None), 10: ("response", None), 11: ("response", None)}


def test_warc_of_missing_repeated_and_text_ids(spark):
    big = "<p>x</p>" * 30
    rows = [(None, "u", big), (4, "u", big), (4, "v", big), (8, None, big), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()), key=str)
    assert got == sorted([(None, "revisit", 4), (4, "response", None), (4, "response", None), (8, "revisit", 4), (None, "response", None)], key=str)
    named = spark.createDataFrame([("a>b", "u", big), ("none", "u", big), ("é", "u", "x")], pages.schema.simpleString()[7:-1].replace("bigint", "string").replace(":", " "))
    got = {r.page_id: r.refers_to for r in warc.round_trip(spark, named).collect()}
    assert got == {"a>b": None, "none": "a>b", "é": None}
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_reads_a_selection_and_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 30) for i in range(40)], "page_id long, url string, html string")
    index = warc.write(warc.roles(pages), str(tmp_path))
    got = warc.read_records(index.where("page_id % 7 = 0"), str(tmp_path), payloads=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: f"page {i} " * 30 for i in range(0, 40, 7)}


# --- 4 Jaccard


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c) and part[i] != part[j]:
                a, b = sorted((part[i], part[j]))
                part = [a if p == b else p for p in part]
    return {i: (len(sets[i]), part[i]) for i in range(len(texts))}


def noisy(seed, copies, words, edits, vocabulary=4000):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_join_equals_brute_force(spark, monkeypatch):
    shared = " ".join(f"common{i}" for i in range(60))
    texts = [None, "", "one two", "ONE two", "a b c d e", " \t\n"]
    texts += noisy(1, 60, 120, 6) + noisy(2, 8, 40, 3) + noisy(3, 5, 300, 9)
    texts += [f"{shared} {t}" for t in noisy(4, 1, 80, 0) + noisy(5, 1, 80, 0) + noisy(6, 1, 30, 0)]
    texts += [texts[8]] * 5 + noisy(7, 20, 60, 0)[:1] * 40
    d = docs(spark, texts).withColumn("node", F.lit("clash")).repartition(3)
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(d).collect()}
    assert got == want


def test_words_are_told_apart_at_any_length(spark):
    """Thue-Morse words and their complements have equal polynomials modulo any power of two; they share nothing."""
    bits = [bin(i).count("1") % 2 for i in range(1 << 17)]
    texts = []
    for n in (1 << 10, 1 << 11, 1 << 14, 100_000, 1 << 17):
        texts += ["".join("ab"[b] for b in bits[:n]), "".join("ba"[b] for b in bits[:n])]
    texts += ["a", "a\x00", "a\x00\x00", "\x00", "abcdefgh", "abcdefghi", "éééé", "éééée"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == {i: (1, i) for i in range(len(texts))}
    whole = "x" * 9 + " " + " ".join(texts) + " ab"
    h, starts = jaccard.word_hashes(whole.encode())
    assert len(set(h.tolist())) == len(texts) + 2 and [whole.encode()[a : a + 1] for a in starts][:2] == [b"x", b"a"]


def test_many_rows_of_one_id(spark):
    """Rows that share an id meet their own class, not those of all the others."""
    texts = noisy(21, 300, 60, 3) + noisy(22, 40, 30, 0) + noisy(23, 30, 50, 2)
    ids = [7] * 300 + [8] * 40 + list(range(100, 130))
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts)], DOCS)
    part = brute_components(texts)
    first = {}
    for k, (_, c) in part.items():
        first[c] = min(first.get(c, 10**9), ids[k])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(d).collect())
    assert got == sorted((ids[k], n, first[c]) for k, (n, c) in part.items())
    assert jaccard.keep_first(d).count() == len({c for _, c in part.values()})


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_regions_split_by_pivots_equal_brute_force(spark, monkeypatch, rounds):
    shared = " ".join(f"common{i}" for i in range(60))
    texts = noisy(1, 60, 120, 6) + noisy(2, 8, 40, 3) + noisy(3, 5, 300, 9) + noisy(11, 40, 60, 9) + noisy(12, 30, 60, 4)
    texts += [f"{shared} {t}" for t in noisy(4, 30, 40, 9) + noisy(5, 20, 30, 9)]
    for name, value in (("SHARE", 1500), ("SMALL", 4), ("PIVOTS", 4), ("SALTED", 2), ("ROUNDS", rounds)):
        monkeypatch.setattr(jaccard, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts).repartition(3)).collect()}
    assert got == brute_components(texts)


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2), st.integers(0, 12), st.integers(5, 14), st.integers(0, 3)), max_size=120), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_stars_connect_what_may_be_linked(rows, size):
    """Rows (shingle, salt, node, n, place) in batches of any size: pairs that may be linked are connected."""
    import pyarrow as pa

    rows = sorted({(s, t, (n << 32) + at, node) for s, t, node, n, at in rows if at < n})
    made: list = []

    class Frame:
        def __getattr__(self, name):
            return lambda *a: self

        def mapInArrow(self, run, schema):
            cut = [rows[i : i + size] for i in range(0, len(rows), size)]
            made.extend(run(iter([pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64()) for k in (0, 1, 3, 2)], list("stnp")) for part in cut])))
            return self

    jaccard.candidates(Frame())
    part: dict = {}

    def find(x):
        while part.get(x, x) != x:
            x = part[x]
        return x

    for b in made:
        for x, y in zip(*b.to_pydict().values()):
            part[find(x)] = find(y)
    groups = collections.Counter((s, t) for s, t, _, _ in rows)
    for s, t, p, x in rows:
        for s2, t2, q, y in rows:
            if (s, t) == (s2, t2) and x != y and p <= q and 5 * (p >> 32) >= 4 * (q >> 32):
                most = min((p >> 32) - (p & 0xFFFFFFFF), (q >> 32) - (q & 0xFFFFFFFF))
                if groups[s, t] > jaccard.SMALL or t or 9 * most >= 4 * ((p >> 32) + (q >> 32)):
                    assert find(x) == find(y)


def test_join_of_repeated_and_missing_ids(spark):
    a = noisy(8, 1, 80, 0)[0]
    b = f"{a} more"
    d = spark.createDataFrame([(1, a), (1, a), (None, b), (None, None), (2, "alone here it is all")], "doc_id long, text string")
    rows = sorted(map(tuple, jaccard.join(d).collect()), key=str)
    assert [r[2] for r in rows if r[0] == 1] == [1, 1]
    assert (2, 1, 2) in rows and len(rows) == 5
    assert any(r[0] is None and r[2] == 1 for r in rows)
    assert jaccard.join(d.limit(0)).count() == 0


@given(st.integers(0, 10**6))
@settings(max_examples=25, deadline=None)
def test_region_solver_connects_what_is_linked(seed):
    import numpy as np

    rng = random.Random(seed)
    base = rng.sample(range(1000), 60)
    sets = [np.unique(np.array([x if rng.random() > 0.06 else rng.randrange(1000) for x in base], np.int64)) for _ in range(25)]
    out = jaccard.solve(list(range(25)), sets)

    def parts(edges):
        part = list(range(25))
        for a, b in edges:
            part = [part[a] if p == part[b] else p for p in part]
        return len(set(part)), {frozenset(i for i in range(25) if part[i] == p) for p in set(part)}

    s = [set(x.tolist()) for x in sets]
    true = [(i, j) for i in range(25) for j in range(i) if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    assert parts(out) == parts(true)


def test_keep_first(spark):
    a = noisy(9, 1, 80, 0)[0]
    d = docs(spark, [a, f"{a} more", "something else entirely in here", a])
    assert sorted(r.doc_id for r in jaccard.keep_first(d).collect()) == [0, 2]


# --- 5 chat


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob b", None), (1, 2, "bob b", None), (2, 0, "system", "x"), (None, 0, "ann", "<|im_end|>")]
    c = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, key string")
    out = chat.rotate(c).collect()
    one = [r for r in out if r.conv_id == 1 and r.perspective == "ann"]
    assert len(one) == 4 and {r.role for r in one} == {"system", "assistant", "user"}
    assert not [r for r in out if r.conv_id == 2]
    nul = [r for r in out if r.conv_id is None]
    assert len(nul) == 1 and "<|im_end|>" not in nul[0].rendered[: -len(chat.CLOSE)]
    for r in chat.dialogues(chat.rotate(c)).collect():
        for m in r.masks:
            assert r.text[m.start : m.end].endswith(chat.CLOSE) and chat.OPEN not in r.text[m.start : m.end]
    assert chat.dialogues(chat.rotate(c.limit(0))).count() == 0


def test_parts_make_up_the_dialogue(spark):
    rng = random.Random(3)
    rows = [(i % 3, rng.randrange(4), rng.choice(["ann", "bob", "system"]), "w" * rng.randrange(30)) for i in range(200)]
    rows += [(7, 0, "ann", "same")] * 40
    r = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    by = collections.defaultdict(list)
    for x in chat.dialogues(r, part=100).collect():
        by[x.conv_id, x.perspective].append(x)
    messages = collections.defaultdict(list)
    for x in r.collect():
        messages[x.conv_id, x.perspective].append((x.turn, x.speaker, x.rendered, x.mask_start, x.mask_end))
    assert set(by) == set(messages)
    for k, parts in by.items():
        parts.sort(key=lambda x: x.part)
        whole = "".join(x.text for x in parts)
        assert whole == "".join(m[2] for m in sorted(messages[k], key=lambda m: m[:3]))
        at, masks = 0, []
        for _, _, said, a, b in sorted(messages[k], key=lambda m: m[:3]):
            if a is not None:
                masks.append((at + a, at + b))
            at += len(said)
        assert masks == [tuple(m) for x in parts for m in x.masks]
        assert all(whole[x.start :].startswith(x.text) and x.part == x.start // 100 or x.part == x.start // 100 for x in parts)


# --- 6 tokens


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return tokens.Counter(public_tokenizers.path("word_bpe_49k.json"))


@given(st.text(alphabet=st.sampled_from(list("aA1 '.é<|>\ńΣσ　")) , max_size=60), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_counts_at_every_prefix(counter, text, n):
    assert counter.count(text) == counter.encode(text)
    assert counter.at(text, n) == counter.encode(text[:n])


def test_special_strings_and_budgets(counter):
    assert counter.count("a<|endoftext|>b c") == counter.encode("a<|endoftext|>b c")
    text = "some words of a longer, unbelievably-long text; 12345 " * 5
    for budget in range(0, 60):
        cut = counter.fit(text, budget)
        assert cut == max(k for k in range(len(text) + 1) if counter.encode(text[:k]) <= budget)
    assert counter.fit("word", 0) == 0
    assert counter.fit("a " + "é" * 5000, 2) == 2 + max(k for k in range(600) if counter.encode("é" * k) <= 1)


def test_a_tokenizer_without_chunks_is_asked_for_whole_texts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    c = tokens.Counter(path)
    assert not c.exact and c.count("a  b c") == c.encode("a  b c") and c.at("a  b c", 3) == c.encode("a  ")
    d = docs(spark, [None, "Hello  there", "x y " * 3000])
    out = {r.doc_id: r for r in tokens.count_tokens(d, path, prefixes=True).collect()}
    assert [out[i].n_tokens for i in range(3)] == [0, c.encode("Hello  there"), c.encode("x y " * 3000)]
    assert out[2].fit_chars is None and out[1].fit_chars == 12


def test_token_query_columns(spark, counter):
    import public_tokenizers

    d = docs(spark, [None, "", "hello world", "x " * 3000]).withColumn("n_tokens", F.lit("clash"))
    out = {r.doc_id: r for r in tokens.count_tokens(d, public_tokenizers.path("word_bpe_49k.json"), prefixes=True).collect()}
    assert [out[i].n_tokens for i in range(4)] == [0, 0, counter.encode("hello world"), counter.encode("x " * 3000)]
    assert out[3].over_limit and not out[2].over_limit and list(out[2].totals)[-1] == out[2].n_tokens


@pytest.mark.parametrize("chunk", ["".join(chr(0x4E00 + i * 7919 % 20000) for i in range(900)), "ab12" * 300, "x" * 900, "é" * 700, "a.b,c" * 150, "日本語テキスト" * 120])
def test_budgets_inside_long_chunks(chunk):
    """Texts without white space: the longest prefix within a budget, against counting every prefix."""
    import public_tokenizers

    counter = tokens.Counter(public_tokenizers.path("word_bpe_49k.json"))
    all_ = [counter.encode(chunk[:k]) for k in range(len(chunk) + 1)]
    for budget in (0, 1, 2, 5, 50, 200, all_[-1] - 1, all_[-1], all_[-1] + 3):
        want = max(k for k, n in enumerate(all_) if n <= budget)
        assert counter.fit(chunk, budget) == want
        assert counter.fit(f"one two {chunk} three", budget + 2) == (want + 8 if all_[-1] > budget else 8 + len(chunk) + (6 if all_[-1] + 1 <= budget else 1)), budget


def test_budget_of_a_text_without_spaces():
    import public_tokenizers

    counter = tokens.Counter(public_tokenizers.path("word_bpe_49k.json"))
    text = "".join(chr(0x4E00 + i * 31 % 20000) for i in range(6000))
    fit = counter.fit(text, 2048)
    assert counter.encode(text[:fit]) <= 2048 < counter.encode(text[: fit + 1]) and fit > 500


# --- 7 personal data


def luhn(d):
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(t):
    out = []
    for k, rx in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(rx, t):
            d = re.sub("[^0-9]", "", m[0])
            if not (k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (13 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "a@b.c-x_d@e.f @g.h 1.2.3.4.5.6.7.8 1.2.3.456 é x@y.zz", "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (743) 555-3824.", "9" * 40000, "a" * 40000 + "@b.cc"]
    texts += ["".join(rng.choice("aB@.-+_ 0123456789()é\n") for _ in range(120)) for _ in range(150)]
    texts += ["".join(rng.choice("0123456789 -.+") for _ in range(80)) for _ in range(80)]
    got = {r.doc_id: r for r in pii.find(docs(spark, texts).withColumn("base", F.lit(0))).collect()}
    for i, t in enumerate(texts):
        want = brute_pii(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(got[i].spans.split(",") if got[i].spans else [])


def test_labelers_add_spans_by_context(spark):
    good = [f"Please call my mobile phone {200 + i}-555-{1000 + i} today." for i in range(40)]
    bad = [f"See invoice number {100 + i % 90}-155-{1000 + i} for it." for i in range(40)]
    texts = good + bad + ["Signed, Mr. John Smith of here.", "tel 219-09-9999"]
    got = {r.doc_id: r.spans for r in pii.find(docs(spark, texts)).collect()}
    assert sum("phone" in got[i] for i in range(40)) >= 36
    assert sum("phone" in got[i] for i in range(40, 80)) <= 4
    assert "name" in got[80]


def test_em_recovers_reliabilities():
    rng = random.Random(4)
    right = (0.9, 0.75, 0.65)  # chance that a labeler that votes is right
    counts = collections.Counter()
    for _ in range(40_000):
        true = rng.random() < 0.4
        votes = []
        for p in right:
            ok = rng.random() < p
            votes.append(0 if rng.random() < 0.2 else 1 if true == ok else -1)
        counts[tuple(votes)] += 1
    model = pii.fit([(v, "phone/short", n) for v, n in sorted(counts.items())])
    assert abs(model.prior - 0.4) < 0.06
    for k, p in enumerate(right):
        assert abs(model.yes[k][2] - 0.8 * p) < 0.06 and abs(model.no[k][0] - 0.8 * p) < 0.06


def test_gazetteers_are_parameters(spark):
    d = docs(spark, [f"Signed, Mr. Zebulon Smith{'abcdefgh'[i % 8]} here." for i in range(40)])
    mine = pii.Lists(given_names=("Zebulon",))
    assert sum("name" in r.spans for r in pii.find(d, lists=mine).collect()) == 40
    r = pii.find(docs(spark, ["a@b.com"])).first()
    assert [(x.kind, x.start, x.end, x.value) for x in r.found] == [("email", 0, 7, "a@b.com")]
    assert pii.find(d.limit(0)).count() == 0


def test_running_sums_in_blocks(spark):
    rng = random.Random(2)
    rows = [[rng.randrange(100) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<int>")
    got = {r.i: (r.s, r.m) for r in df.select("i", pii.running(F.col("v"), lambda a, b: a + b, 0).alias("s"), pii.running(F.col("v"), F.greatest, 0).alias("m")).collect()}
    for i, r in enumerate(rows):
        assert got[i] == ([sum(r[: k + 1]) for k in range(len(r))], [max(r[: k + 1]) for k in range(len(r))])


def test_loose_spans_beside_many_base_spans(spark, monkeypatch):
    """Both ways to find the loose spans that overlap no base span agree."""
    rng = random.Random(3)
    parts = ["ann@x.org", "+1 555 123 4567", "555-1234", "123-45-6789", "Mr. Smith", "10.0.0.1", "4111 1111 1111 1111", "word", "415.555.2671"]
    texts = [" ".join(rng.choice(parts) + rng.choice(["", ",", "-1"]) for _ in range(n)) for n in (3, 40, 400)] + [None, "", "555-1234"]
    results = []
    for block in (256, 1):
        monkeypatch.setattr(pii, "BLOCK", block)
        results.append(sorted((r.doc_id, str(r.base), str(r.loose)) for r in pii.extract(docs(spark, texts)).collect()))
    assert results[0] == results[1] and any("ssn" in r[2] for r in results[0])


# --- 8 shards


def check_shards(rows, n):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(0 <= s < n for s in by)
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    return [sum(r.size for r in by[s]) for s in range(n)]


def test_shards_are_near_equal_and_gapless(spark):
    rng = random.Random(3)
    texts = ["w" * rng.randrange(200) for _ in range(600)] + ["the same text"] * 500 + [None, "", "é" * 50]
    out = shards.assign(docs(spark, texts).withColumn("shard", F.lit(9)), shards=6).collect()
    sizes = check_shards(out, 6)
    assert len(out) == len(texts) and max(sizes) - min(sizes) <= 2 * max(r.size for r in out)
    for r in out:
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 8, zlib.crc32(b))
    again = {r.doc_id: (r.shard, r.slot) for r in shards.assign(docs(spark, texts).repartition(5), shards=6).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in out}


def test_bins_of_a_hot_text_are_cut_by_id(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)] + [(None, "the same text")] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = shards.keyed(d)
    placed = shards._bins(keyed, 3050, 20).collect()
    biggest = collections.Counter(r["_bin"] for r in placed).most_common(2)
    assert biggest[0][1] <= 130 and biggest[1][1] <= 80
    assert [r["_bin"] for r in sorted(placed, key=lambda r: r.key)] == sorted(r["_bin"] for r in placed)
    out = shards.shard(keyed, 5, rows_per_bin=20).collect()
    sizes = check_shards(out, 5)
    assert len(out) == 3050 and max(sizes) - min(sizes) <= 2200
    full = shards.sharded(d.withColumn("size", F.lit("clash")), 5)
    assert full.count() == 3050 and "text" in full.columns and full.columns.count("size") == 1


def test_shards_of_few_repeated_and_no_rows(spark):
    assert shards.assign(docs(spark, []), shards=4).count() == 0
    d = spark.createDataFrame([(1, "a")] * 7 + [(None, "b")] * 3, "doc_id long, text string")
    out = shards.assign(d, shards=4).collect()
    check_shards(out, 4)
    assert len(out) == 10


# --- 9 quality


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = collections.Counter(win)
    rep = {k for i, x in enumerate(win) if many[x] > 1 for k in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_measures_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a b c a b c", "x\x0by\x1cz\xa0q", "###\n###\n ###"]
    texts += [" ".join(rng.choice(["a", "b", "é", "d#", "e\n", "f\tg", "h  i"]) for _ in range(rng.randrange(120))) for _ in range(120)]
    got = {r.doc_id: r for r in quality.apply_rules(docs(spark, texts).withColumn("n_words", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_rules_keep_prose_and_drop_junk(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.good_documents(d).collect()}
    rows = {r.doc_id: r for r in quality.apply_rules(d).collect()}
    assert kept == {i for i, r in rows.items() if r.kept}
    junk = docs(spark, ["word### " * 5 + " ".join(f"w{i}***" for i in range(80)), " ".join(f"WORD{i}!!" for i in range(80)), "the cat sat on it and then it was " + " ".join(f"word{i} of the" for i in range(60))])
    assert {r.doc_id for r in quality.good_documents(junk).collect()} == {2}


def test_rules_with_columns_of_any_name(spark):
    """Columns named as the operator's own, or as its results, in any case."""
    text = "the cat sat on the mat and it was good " * 10
    df = docs(spark, [text, None])
    names = ["_words", "_lines", "_chars", "_symbols", "_upper", "_made", "_WORDS_", "made__", "kept", "n_words", "a.b"]
    for c in names:
        df = df.withColumn(c, F.lit("mine"))
    plain = [tuple(r) for r in quality.apply_rules(docs(spark, [text, None])).select("doc_id", "n_words", "kept").collect()]
    out = quality.apply_rules(df)
    assert [tuple(r) for r in out.select("doc_id", "n_words", "kept").collect()] == plain
    assert {r["_words"] for r in out.collect()} == {"mine"} and {r["a.b"] for r in out.collect()} == {"mine"}
    assert quality.good_documents(df).columns == df.columns


# --- 10 mixing


def test_targets_are_capped_and_reshared():
    t = mixing.targets([("b", 100), ("a", 10), (None, 50)])
    assert t["a"] == 20.0 and sum(t.values()) == pytest.approx(240) and t["b"] == pytest.approx((240 - 20) * 2 / 3)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


@given(st.lists(st.tuples(st.integers(0, 500), st.floats(0.01, 0.99)), max_size=60), st.integers(0, 99))
@settings(max_examples=150, deadline=None)
def test_flight_keeps_both_totals(units, seed):
    p = mixing.flight([(float(s), x) for s, x in units], random.Random(seed))
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(sum(x for _, x in units), abs=1e-5)
    assert sum(x * s for x, (s, _) in zip(p, units)) == pytest.approx(sum(s * x for s, x in units), abs=1e-2)


def test_flight_is_unbiased():
    units = [(float(s), 0.3) for s in (5, 9, 2, 40, 7, 7, 12, 30)]
    runs = [mixing.flight(units, random.Random(i)) for i in range(3000)]
    for k in range(len(units)):
        assert sum(r[k] for r in runs) / len(runs) == pytest.approx(0.3, abs=0.04)


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), "en", f"s{i % 4}" if i % 5 else None, 0) for i in range(900)] + [(900, None, "en", "s1", 0), (901, "", "en", "s1", 0)]
    d = spark.createDataFrame(rows, DOCS)
    out = mixing.plan(d, bucket=100).collect()
    by = collections.defaultdict(int)
    for r in out:
        by[(r.source, r.target)] += r.size * r.copies
        assert 0 <= r.copies <= 2
    assert len(out) == len(rows) and all(abs(v - t) <= 60 for (_, t), v in by.items())
    key = lambda rs: sorted((r.doc_id, r.copies) for r in rs)
    assert key(out) == key(mixing.plan(d.repartition(7), bucket=100).collect())
    mixed = collections.Counter(r.doc_id for r in mixing.mix(d, bucket=100).collect())
    assert mixed == collections.Counter({r.doc_id: r.copies for r in out if r.copies})


def test_many_sources_land_in_few_levels(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 30), "en", f"s{i % 1500}", 0) for i in range(9000)]
    rows += [(9000 + i, "w " * rng.randrange(1, 30), "en", "large", 0) for i in range(900)]
    d = spark.createDataFrame(rows, DOCS)
    levels = []
    own = mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda df, tag: levels.append(tag) or own(df, tag))
    out = sorted(map(tuple, mixing.plan(d, bucket=100).collect()))
    assert sum(t.startswith("flight") for t in levels) <= 3
    by = collections.Counter()
    for _, source, size, _, target, copies in out:
        by[source, target] += size * copies
    assert len(out) == len(rows) and all(abs(v - t) <= 30 for (_, t), v in by.items())
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 10)
    again = sorted(map(tuple, mixing.plan(d, bucket=100).collect()))
    assert [(*r[:4], round(r[4], 6), r[5]) for r in again] == [(*r[:4], round(r[4], 6), r[5]) for r in out]


def test_landing_keeps_tokens_near():
    rng = random.Random(8)
    for _ in range(200):
        units = [(float(rng.choice([3, 10, 40, 40, 40, 900])), 0.4) for _ in range(rng.randrange(40, 400))]
        p = mixing.land(units, rng)
        assert set(p) <= {0.0, 1.0}
        few = sum(s for s, _ in units if s < 900) < 2500  # then the large ones can't be made up for
        assert abs(sum(s * (x - 0.4) for (s, _), x in zip(units, p))) <= (450 if few else 40)
        assert abs(sum(x - 0.4 for x in p)) <= 0.5 * len(units)


def test_mix_of_repeated_rows_and_of_none(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", 3)] * 6 + [(None, "c", "en", "t", 1)] * 2, DOCS)
    assert mixing.plan(d).count() == 8
    assert sum(r.copies for r in mixing.plan(d).collect()) == mixing.mix(d).count()
    assert mixing.mix(d.limit(0)).count() == 0
    clash = d.withColumns({c: F.lit(1) for c in ("_k", "_id", "_src", "_size", "_copies", "_rows", "rows", "copies", "row", "id", "t", "i")})
    out = mixing.mix(clash)
    assert out.columns == clash.columns and out.count() == mixing.mix(d).count()
    text_ids = mixing.plan(d.withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))).collect()
    assert {r.doc_id for r in text_ids} == {"x1", None}


# --- empty tables, clashing columns, heavy keys


def test_empty_tables(spark):
    import public_tokenizers

    none = docs(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert urls.judge(pages, spark.createDataFrame([], "page_id long, bad int"), Q.RULES).count() == 0
    sam = decontaminate.build(spark, bench)
    assert decontaminate.digest(none, sam).count() == 0 and decontaminate.clean(none, sam).count() == 0
    some = docs(spark, ["a b c", None])
    assert sorted(r.n_hit for r in decontaminate.digest(some, sam).collect()) == [0, 0]
    assert tokens.count_tokens(none, public_tokenizers.path("word_bpe_49k.json"), prefixes=True).count() == 0
    assert quality.apply_rules(none).count() == 0 and jaccard.keep_first(none).count() == 0
    assert shards.sharded(none).count() == 0


def test_heavy_keys_are_salted(spark):
    from quire.llm.common import heavy_keys, salted_join

    left = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 1), (None, 2), (3, 3)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, w string")
    heavy = heavy_keys(left.groupBy("k").count(), "k", "count", share=3, least=5)
    assert heavy == [1]
    got = collections.Counter((r.k, r.w) for r in salted_join(left, right, "k", heavy).collect())
    assert got == {(1, "a"): 300, (2, "b"): 1, (None, None): 1, (3, None): 1}
    rows = spark.createDataFrame([(bytearray(b"x"), i) for i in range(9)], "k binary, v long")
    table = spark.createDataFrame([(bytearray(b"x"), 1)], "k binary, w long")
    assert salted_join(rows, table, "k", heavy_keys(rows.groupBy("k").count(), "k", "count", least=2)).where("w = 1").count() == 9


# --- the pipeline


def test_pipeline_of_nulls_repeats_and_long_texts(spark, tmp_path):
    import corpus_pipeline as c

    prose = lambda k, n: " ".join(f"the wo{k + 3 * i}rd gave of{k + 3 * i + 1}fer to ma{k + 3 * i + 2}ny" for i in range(n))
    rows = [(i, prose(i * 1000, 20), "en", f"s{i % 2}", 0, "x") for i in range(40)]
    rows += [(None, prose(7 * 1000, 20), "en", None, 0, "x"), (3, rows[3][1], "en", "s1", 0, "x"), (99, None, None, None, None, None), (98, "", "fr", "s1", 0, "x"), (97, prose(10**6, 4000), "en", "s0", 0, "x")]
    d = spark.createDataFrame(rows, DOCS + ", row string")
    for t in (d, d.limit(0)):
        steps = t
        for name, stage in c.STAGES:
            steps = c.materialise(stage(spark, steps, SF), name.replace(" ", "_"))
        assert "row" in steps.columns and "text" in steps.columns
        ids = collections.Counter(r.doc_id for r in steps.collect())
        assert not {98, 99, None} & set(ids) and (97 in ids or t is not d)


def test_stages_keep_their_promises(spark, sf):
    import corpus_pipeline as c

    raw = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [raw]
    for name, stage in c.STAGES:
        steps.append(c.materialise(stage(spark, steps[-1], sf), name.replace(" ", "_")))
    for df in steps[1:-1]:
        assert df.columns == raw.columns
    ids = [[r.doc_id for r in df.select("doc_id").collect()] for df in steps]
    assert set(ids[1]) == {r.doc_id for r in quality.apply_rules(raw).where("kept").collect()}
    first = {r.doc_id: r.text for r in steps[1].collect()}
    order = sorted(first)
    part = brute_components([first[i] for i in order])
    assert sorted(ids[2]) == sorted({order[p] for _, p in part.values()})
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert all(brute_hits(r.text, items)[1] == 0 for r in steps[3].collect())
    kept3 = {r.doc_id: r.text for r in steps[2].collect()}
    assert {i for i, t in kept3.items() if not brute_hits(t, items)[1]} <= set(ids[3])
    assert max(collections.Counter(ids[4]).values()) <= 2
    assert len(ids[5]) == len(ids[4])
    check_shards(steps[5].collect(), 24)
