"""Operators against brute force, on a small table with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm._bpe import word_model
from tessera.llm._words import find_words, sliding_minimum_at, text_bytes
from tessera.llm.bpe import encode_documents
from tessera.llm.language_id import identify
from tessera.llm.line_dedup import remove_boilerplate
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_documents, plan_slots
from tessera.llm.quality import quality
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.token_counts import section_tokens, share_out
from tessera.llm.top_k import scaled_vectors, top_k
from tessera.llm.vocabularies import vocabulary
from tessera.llm.warc import canonical_url, resolve_revisits

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, key int, ids string"


def passage(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"w{r.integers(0, 5000)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and blank texts, a very long one, repeated rows, near and exact copies, shared passages; columns with clashing names."""
    shared = passage(1, 60)
    base = passage(2, 120).split()
    texts = [None, "", " \n\t ", "one", "Two Words", shared, f"{passage(3, 30)} {shared} {passage(4, 30)}", f"{shared}\n{shared}", " ".join(base), " ".join(base).upper()]
    texts += [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in (5, 50, 100)] + [" ".join(base[:60] + passage(5, 60).split())]
    texts += [" " * 70000 + "x" + "\n" * 70000, "\t" * 66000 + "<|endoftext|>" + " " * 66000, "ab" * 3000, passage(6, 20000), "é" * 3000 + " ß \x00 " + "don't <|endoftext|> 🙂", "#*$%&|<> " * 20, "a b c " * 40, "line\nline\nother\n\nline"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2"][i % 3], None, "b", i, "i") for i, t in enumerate(texts)]
    return rows + [rows[8], (None, shared, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def order(rows):
    return sorted(rows, key=str)


def test_words_and_minima():
    import pyarrow as pa

    found = find_words(*text_bytes(pa.array(["ab", "cd e", None, "", " f"])))
    assert found.counts.tolist() == [1, 2, 0, 0, 1]
    values = np.random.default_rng(0).integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 5, 26):
        assert sliding_minimum_at(values, width).tolist() == [i + int(np.argmin(values[i : i + width])) for i in range(200 - width + 1)]


def test_window_hashes_are_polynomials():
    from tessera.llm._words import BASES, PRIME, hashes_at, window_hashes

    values = np.random.default_rng(4).integers(0, PRIME, 300, dtype=np.uint64)
    for size in (1, 2, 13, 25, 50):
        found, some = window_hashes(values, size, BASES[0]), hashes_at(values, np.array([7, 9]), size, BASES[0])
        for i in (0, 7, 9, 300 - size):
            assert int(found[i]) == sum(int(v) * pow(BASES[0], k, PRIME) for k, v in enumerate(values[i : i + size])) % PRIME
        assert some.tolist() == found[[7, 9]].tolist()


def test_word_keys_spell_words_out():
    import pyarrow as pa

    words = ["a", "A", "ab", "a" * 8, "a" * 9, "a" * 15, "a" * 16, "a" * 17, "\x00", "\x00\x00", "ü", "x" * 7 + "\x00"]
    keys = list(zip(*find_words(*text_bytes(pa.array([" ".join(words)]))).keys()))
    assert len(set(keys)) == len(words)
    low = list(zip(*find_words(*text_bytes(pa.array(["Ab aB AB ÄB äB"]))).keys(lower=True)))
    assert low[0] == low[1] == low[2] and low[3] != low[4]


def repeats(rows, size):
    first, out = {}, []
    for _, words, i in sorted((10**9 if i is None else i, WORD.findall(t or ""), i) for i, t in rows):
        del _
        out.append((i, words))
    for i, words in out:
        for k in range(len(words) - size + 1):
            key = tuple(words[k : k + size])
            rank = 10**9 if i is None else i
            first[key] = min(first.get(key, rank), rank)
    result = []
    for i, words in out:
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < (10**9 if i is None else i):
                gone[k : k + size] = [True] * size
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        result.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return order(result)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_substring_dedup(table, request):
    docs = request.getfixturevalue(table)
    got = remove_repeats(docs)
    assert order(tuple(r)[:4] for r in got.collect()) == repeats(plain(docs), 50)
    for r in got.filter("n_removed > 0").collect():
        kept = " ".join(WORD.findall(r.kept_text))
        assert hashlib.sha256(kept.encode()).hexdigest() == r.kept_sha256


def components(rows, words, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = WORD.findall((text or "").translate(low))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    group = defaultdict(list)
    for a in range(len(rows)):
        if rows[a][0] is not None:
            group[top(a)].append(rows[a][0])
    return order((rows[a][0], len(sets[a]), min(group[top(a)], default=None) if sets[a] else rows[a][0]) for a in range(len(rows)))


@pytest.mark.parametrize(("table", "words"), [("odd", 2), ("documents", 2), ("documents", 5)])
def test_near_duplicates(table, words, request):
    docs = request.getfixturevalue(table)
    got = near_duplicates(docs, words=words).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(plain(docs), words, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_packing(table, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(table)
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken")).collect()
    expected, places, total = [], defaultdict(list), 0
    for i, text in plain(docs):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        head = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        cuts = sorted({0, *range(head, len(ids) + 1, 1024), len(ids)})
        expected += [(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4")), ids[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in rows) == order(expected)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for place in places.values():
        place.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(place, place[1:], strict=False)) and place[0][0] == 0 and sum(place[-1]) <= 1024
    assert len(places) <= 1.1 * total / 1024 + 1


def test_plan_is_best_fit_and_small():
    r = np.random.default_rng(3)
    histogram = {int(k): int(v) for k, v in zip(range(1, 101), r.integers(0, 50, 100), strict=True) if v}
    slots = plan_slots(histogram, 100)
    room = Counter()
    for length, low, high, first, offset in slots:
        for k in range(high - low):
            room[first + k] += length
            assert offset + length <= 100
    for length, n in histogram.items():
        assert sorted(x for s in slots if s[0] == length for x in range(s[1], s[2])) == list(range(n))
    assert max(room.values()) <= 100
    lengths, bins = sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True), []
    for x in lengths:
        fit = min((b for b in bins if b >= x), default=None)
        if fit is None:
            bins.append(100 - x)
        else:
            bins[bins.index(fit)] -= x
    assert len(room) == len(bins)
    assert len(plan_slots({k: 10**9 for k in range(1, 1025)}, 1024)) < 20000


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_bpe(table, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(table)
    model = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = {(r.doc_id, r.ids_sha256): r for r in encode_documents(docs, vocabulary("word_bpe_49k.json")).collect()}
    for i, text in plain(docs):
        ids = model.encode(text or "", add_special_tokens=False).ids
        r = got[i, hashlib.sha256(np.array(ids, "<u4")).hexdigest()]
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, model.decode(ids, skip_special_tokens=False))
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_very_long_runs():
    """Two million blanks, line feeds and letters, and a word of 200,000 letters."""
    import time

    from tokenizers import Tokenizer

    from tessera.llm.packing import encoding, token_ids

    r = np.random.default_rng(9)
    word = "".join(map(chr, r.integers(97, 123, 200_000)))
    library, model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), encoding(vocabulary("byte_bpe_50k.tiktoken"))
    n = 2_000_000
    for text in (" " * n, "a" + "\n" * n + "b", " \n" * (n // 2) + "\x1cq", "\u3000" * (n // 3) + "é", "x" + " " * n + "<|endoftext|>" + "\t" * n + "'s", word * 10):
        assert token_ids(model, text).tolist() == library.encode(text, add_special_tokens=False).ids
    library, model = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), word_model(vocabulary("word_bpe_49k.json"))
    start = time.time()
    ids, at = model.encode(["some words", word, "", "a" * 5000, "and more", word[:3000] + " b"])
    assert time.time() - start < 6
    for i, text in enumerate(["some words", word, "", "a" * 5000, "and more", word[:3000] + " b"]):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_on_random_text():
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), word_model(vocabulary("word_bpe_49k.json"))
    r = np.random.default_rng(5)
    letters = list("aaabcdeerstΣσςİıßé'") + ["'s", "'RE", " ", "\n", "\x1c", "é", "½", "Ⅷ", "一", "😀", "-", "<|endoftext|>", "'ll"]
    texts = ["".join(r.choice(letters, r.integers(0, 60))) for _ in range(1500)]
    ids, at = model.encode(texts)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_quality_counts(odd, documents):
    for docs in (odd, documents):
        got = quality(docs).collect()
        expected = []
        for i, text in plain(docs):
            text = text or ""
            w = WORD.findall(text)
            seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
            covered = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
            lines, again = set(), 0
            for line in text.split("\n"):
                if WORD.search(line):
                    again += line in lines
                    lines.add(line)
            failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
            expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed))
        assert order(tuple(r)[:7] for r in got) == order(expected)
        assert not any(r.kept and r.base_failed for r in got)


def test_quality_rejects_noise_and_keeps_prose(spark, documents):
    r = np.random.default_rng(9)
    noise = " ".join("".join(r.choice(list("qxzjkvwy0189~^@"), 7)) for _ in range(80))
    rows = spark.createDataFrame([(10**6, noise, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality(documents.unionByName(rows)).collect()}
    assert not got[10**6].base_failed and not got[10**6].kept
    assert sum(not r.kept and not r.base_failed for r in got.values()) < 0.02 * len(got)


def test_quality_bands_reject_above(spark, documents):
    """Shuffled letters and a wrong label go; prose with a passage in another language stays, and a text mostly in another goes."""
    r = np.random.default_rng(4)
    usual = [d for d in documents.orderBy("doc_id").collect() if d.text and 800 < len(d.text) < 4000 and " | " not in d.text]
    prose = {name: [d for d in usual if d.lang == name] for name in ("en", "de")}
    kept = {d.doc_id for d in quality(documents).filter("kept").collect()}
    english, german = ([d.text for d in prose[name] if d.doc_id in kept][:2] for name in ("en", "de"))
    cases = [("letters", "".join(r.permutation(list(t))), "en") for t in english] + [("label", english[0], "de")]
    cases += [("passage", e[:600] + "\n" + d[:200], "en") for e, d in zip(english, german)]
    cases += [("mostly", e[:200] + "\n" + d[:600], "en") for e, d in zip(english, german)]
    rows = spark.createDataFrame([(10**6 + i, t, lang) for i, (_, t, lang) in enumerate(cases)], "doc_id long, text string, lang string")
    got = {d.doc_id: d.kept for d in quality(documents.select("doc_id", "text", "lang").unionByName(rows)).collect()}
    share = {kind: np.mean([got[10**6 + i] for i, c in enumerate(cases) if c[0] == kind]) for kind in ("letters", "label", "passage", "mostly")}
    assert {k: share[k] for k in ("letters", "label", "mostly")} == {"letters": 0, "label": 0, "mostly": 0}
    assert share["passage"] == 1


def kneser_ney(texts):
    """By brute force, for the texts of one language: -ln p of a four-gram, by its code points."""
    holders = defaultdict(set)
    counts = {4: Counter()}
    for text in texts:
        padded = "\n\n\n" + text
        for k in range(len(text)):
            counts[4][padded[k : k + 4]] += 1
            for order_ in range(1, 5):
                holders[padded[k + 4 - order_ : k + 4]].add(text)
    for order_ in (3, 2, 1):
        counts[order_] = Counter(g[1:] for g in counts[order_ + 1])

    def discount(order_, n):
        of = Counter(min(c, 5) for c in counts[order_].values())
        plain = {1: 0.5, 2: 0.75, 3: 0.9}[min(n, 3)]
        if not of[1] or not of[2]:
            return plain
        y, k = of[1] / (of[1] + 2 * of[2]), min(n, 3)
        if not of[k]:
            return plain
        found = k - (k + 1) * y * of[k + 1] / of[k]
        return found if 0 < found < k else plain

    discounts = {(order_, n): discount(order_, n) for order_ in range(1, 5) for n in (1, 2, 3)}
    contexts = defaultdict(list)
    for order_ in range(1, 5):
        for g, n in counts[order_].items():
            contexts[order_, g[:-1]].append((g, n))

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        order_ = len(gram)
        inside = contexts[order_, gram[:-1]]
        total = sum(n for _, n in inside)
        own = {g: n - discounts[order_, min(n, 3)] for g, n in inside if len(holders[g]) > 1}
        return own.get(gram, 0) / total + (1 - sum(own.values()) / total) * p(gram[1:])

    return lambda gram: -np.log(p(gram))


def test_perplexity_and_bands_against_brute_force(spark):
    """Scores and verdicts of a small table in several scripts; a text that only copies hold does not vouch for itself."""
    r = np.random.default_rng(12)
    words = {"en": "the cat sat on a mat and saw it all".split(), "el": "και το να με του που για από".split(), "zh": list("的一是在不了有和人这中大")}
    rows = []
    for name, of in words.items():
        rows += [(len(rows) + k, " ".join(r.choice(of, r.integers(55, 90))), name) for k in range(25)]
    rows += [(200, "".join(r.choice(list("αβγδεζηθικλμ "), 1200)), "el"), (201, rows[0][1], "el"), (202, rows[1][1], None), (203, None, "en"), (204, "", "zh"), (205, rows[3][1] * 2, "en"), (206, rows[3][1] * 2, "en")]
    got = {d.doc_id: d for d in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("stream", F.lit(1))).collect()}
    scores = defaultdict(dict)
    for name in ("en", "el", "zh", None):
        texts = [(i, t) for i, t, lang in rows if lang == name and t]
        cost = kneser_ney([t for _, t in texts])
        for i, text in texts:
            padded = "\n\n\n" + text
            each = [cost(padded[k : k + 4]) for k in range(len(text))]
            assert abs(got[i].log_perplexity - np.mean(each)) < 1e-4
            pieces = max(1, len(text) // 128)
            cuts = [128 * k for k in range(pieces)] + [len(text)]
            passages = sorted(np.mean(each[a:b]) for a, b in zip(cuts, cuts[1:]))
            assert abs(got[i].passage_perplexity - passages[(pieces - 1) // 2]) <= 0.0006
            if not got[i].base_failed:
                scores[name][i] = round(1000 * got[i].passage_perplexity)
    rejected = set()
    for of in scores.values():
        ranked = sorted(of.values())
        low, middle, high = (ranked[int(np.ceil(q * len(ranked) - 1e-9)) - 1] for q in (0.1, 0.5, 0.9))
        rejected |= {i for i, s in of.items() if not middle - max(100, 4 * (middle - low)) <= s <= middle + max(100, 4 * (high - middle))}
    assert {i for i, d in got.items() if not d.kept} == rejected | {i for i, d in got.items() if d.base_failed}
    assert {200, 201} <= rejected and got[203].log_perplexity is None and got[202].language == "und"


def test_model_is_a_distribution(spark):
    """In every context the probabilities of the n-grams, and of the mass left to the order below, add up to one."""
    from tessera.llm.perplexity import UNIT, fitted

    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("abcd "), 200)) for _ in range(6)]
    counts = [("x", ("\n\n\n" + t)[k : k + 4], 1, i, i) for i, t in enumerate(texts) for k in range(len(t))]
    model = {d.gram: np.exp(-d.cost / UNIT) for d in fitted(spark.createDataFrame(counts, "language string, gram string, n long, low long, high long")).collect()}
    cost = kneser_ney(texts)
    for gram, p in model.items():
        assert abs(np.exp(-cost(gram)) - p) < 1e-4
    for context in {g[:3] for g in model}:
        assert abs(sum(np.exp(-cost(context + c)) for c in "abcd ") - 1) < 0.2  # the rest is for symbols that were never seen


def thue_morse(n):
    """Two words of n letters, each the other with a and b exchanged: polynomials modulo 2**64 take them for equal."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_weak_hashes_confuse(spark):
    from tokenizers import Tokenizer

    x, y = thue_morse(2048)
    start = passage(3, 49)
    texts = [(1, f"{start} {x}"), (2, f"{start} {y}"), (3, f"{x} {x}"), (4, f"{y} {y}"), (5, f"{x}\n{y}"), (6, " ".join(x)), (7, " ".join(y)), (8, f"{start} {x}")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    assert order(tuple(d)[:4] for d in remove_repeats(docs).collect()) == repeats(texts, 50)
    for words in (2, 5):
        assert order((d.doc_id, d.n_shingles, d.component_id) for d in near_duplicates(docs, words=words).collect()) == components(texts, words, 80)
    judged = {d.doc_id: d for d in quality(docs).collect()}
    assert (judged[5].n_dup_lines, judged[5].n_repeat_words, judged[3].n_repeat_words) == (0, 0, 0)
    model = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = {d.doc_id: d.ids for d in encode_documents(docs, vocabulary("word_bpe_49k.json")).collect()}
    assert got == {i: model.encode(t, add_special_tokens=False).ids for i, t in texts}


def test_near_duplicates_of_rows_that_share_an_id(spark):
    a, b = passage(1, 100), passage(2, 100)
    rows = [(1, a), (7, f"{a} z"), (7, b), (9, f"{b} z"), (None, f"{b} y"), (None, passage(3, 90)), (None, passage(3, 90))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "rep": F.lit(2)}), words=2, whole_rows=True).collect()
    assert order((d.doc_id, d.row["text"], d.component_id, d.leader) for d in got if d.row["text"] != passage(3, 90)) == order(
        [(1, a, 1, True), (7, f"{a} z", 1, False), (7, b, 7, True), (9, f"{b} z", 7, False), (None, f"{b} y", 7, False)]
    )
    assert sorted((d.component_id is None, d.leader, d.kept) for d in got if d.row["text"] == passage(3, 90)) == [(True, False, False), (True, True, True)]


def test_special_tokens_in_a_row():
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), word_model(vocabulary("word_bpe_49k.json"))
    text = "<|endoftext|>" * 3000 + "a<|startoftext|><|endoftext|><|endof" + "text|>"
    assert model.encode([text, None, text])[0].tolist() == 2 * library.encode(text, add_special_tokens=False).ids


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n  Menu \n\nrare", f"site{i % 12}") for i in range(24)] + [(99, None, "x"), (100, "", None), (None, "Menu\nq", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in remove_boilerplate(docs.withColumn("lost", F.lit(1)), min_sites=12).collect()}
    assert (got[0].n_lines, got[0].n_removed, got[0].kept_text) == (4, 0, "own 0\n  Menu \n\nrare")
    assert (got[5].n_lines, got[5].n_removed, got[5].kept_text) == (4, 2, "own 5\n")
    assert (got[99].n_lines, got[99].kept_text, got[100].n_lines, got[100].kept_text) == (0, None, 1, "")
    assert got[None].kept_text == "q"
    few = {r.doc_id: r.n_removed for r in remove_boilerplate(docs, min_sites=14).collect()}
    assert set(few.values()) == {0}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    expected = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert order(map(tuple, df.select(columns).collect())) == order(expected)


def test_top_k_with_odd_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(40)]
    rows += [(400, None), (401, [float("nan")] * 8), (402, [None] + [0.1] * 7), (403, [float("inf")] * 8), (404, [0.9] * 3), (405, [])]
    table = scaled_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit(7)))
    got = top_k(table, table.filter("vec_id % 20 = 0"), k=7).collect()
    vectors = {r.vec_id: np.pad(np.array(r.vector, int), (0, 8 - len(r.vector))) for r in table.collect()}
    assert not {400, 401, 402, 403} & set(vectors)
    expected = []
    for q in (v for v in vectors if v % 20 == 0):
        best = sorted((-int(vectors[q] @ x), v) for v, x in vectors.items() if v != q)[:7]
        expected += [(q, k + 1, v, -s) for k, (s, v) in enumerate(best)]
    assert order(map(tuple, got)) == order(expected)
    few = table.filter("vec_id < 5")
    assert top_k(few, few.filter("vec_id = 0"), k=20).count() == 4


def brute_top_k(vectors, queries, k):
    out = []
    for q in queries:
        best = sorted((-sum(a * b for a, b in zip(vectors[q], x)), v) for v, x in vectors.items() if v != q)[:k]
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(best)]
    return order(out)


def clusters(n, width, centres, spread, scale, seed):
    r = np.random.default_rng(seed)
    at = r.normal(0, scale, (centres, width))
    return {i: [int(x) for x in np.floor(at[r.integers(centres)] + r.normal(0, spread, width))] for i in range(n)}


@pytest.mark.parametrize("scale", [100, 10**8])
def test_top_k_on_clusters(spark, scale):
    """Ties, repeated ids, and components whose products pass 2**53."""
    vectors = clusters(1500, 6, 12, scale / 50, scale, 1)
    vectors |= {1500 + i: vectors[i] for i in range(40)}
    rows = [*vectors.items(), *((i, [x + 1 for x in vectors[i]]) for i in range(0, 60, 20)), (3, vectors[3])]
    least = {}
    for i, x in rows:
        least[i] = min(least.get(i, x), x)
    table = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = top_k(table, table.filter("vec_id % 20 = 0"), k=5).collect()
    assert order(map(tuple, got)) == brute_top_k(least, [i for i in least if i % 20 == 0], 5)


def test_top_k_bounds_prune_clusters():
    """With clusters, few rows reach the floor of a query, and groups of queries need few rows."""
    from tessera.llm.top_k import _axes, passing

    x = np.array(list(clusters(4000, 16, 60, 3, 100, 5).values()))
    axes = _axes(x[::63])
    v = x.astype(float)
    cell = (v @ axes.T).argmax(1)
    b = (v * axes[cell]).sum(1)
    w = np.linalg.norm(v - b[:, None] * axes[cell], axis=1)
    q = v[::20]
    scores = q @ v.T
    floor = np.sort(scores, axis=1)[:, -20]
    home = np.argsort(-(q @ axes.T), axis=1)[:, :3]
    open_ = passing(q, floor, home, cell, b, w, axes)
    solved_before = (cell[None, :, None] == home[:, None, :]).any(2)
    assert not ((scores > floor[:, None]) & ~open_ & ~solved_before).any()
    assert (open_ | solved_before).mean() < 0.25


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_section_tokens(table, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(table)
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for separator in ("\n", "e"):
        got = section_tokens(docs, vocabulary("byte_bpe_50k.tiktoken"), separator=separator).collect()
        expected = []
        for i, text in plain(docs):
            text = text or ""
            pieces = [p + separator for p in text.split(separator)[:-1]] + [text.split(separator)[-1]]
            pieces = [p for p in pieces if p]
            owner = [k for k, p in enumerate(pieces) for _ in p]
            tokens, shared = Counter(), Counter()
            for a, b in model.encode(text, add_special_tokens=False).offsets:
                part = Counter(owner[a:b])
                chosen = min(part, key=lambda k: (-part[k], k))
                tokens[chosen] += 1
                shared[chosen] += len(part) > 1
            starts = np.r_[0, np.cumsum([len(p) for p in pieces])]
            expected += [(i, k, int(starts[k]), len(p), tokens[k], shared[k]) for k, p in enumerate(pieces)]
        assert order(map(tuple, got)) == order(expected)


def test_share_out_takes_the_first_on_ties():
    section, crosses = share_out(np.array([0, 2, 3]), np.array([2, 6, 9]), np.array([0, 4, 6, 9]))
    assert section.tolist() == [0, 0, 2] and crosses.tolist() == [False, True, True]


def test_language_id(spark, documents):
    train, held = documents.filter("doc_id % 5 <> 0"), documents.filter("doc_id % 5 = 0")
    rows = held.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    got = {r.id: r for r in identify(rows, train).collect()}
    truth = {r.doc_id: r.lang for r in held.collect()}
    assert sum(got[i].language == lang for i, lang in truth.items()) >= 0.95 * len(truth)
    odd = [(1, None, "de-AT", "a.example.de"), (2, "", None, None), (3, "zzz", "xx", "q"), (4, None, None, "b.example.fr")] + [(10 + i, None, None, "h.de") for i in range(3)]
    odd = {r.id: r for r in identify(spark.createDataFrame(odd, "id long, text string, declared string, host string"), train).collect()}
    assert odd[1].language == "de" and odd[4].language == "fr" and odd[11].language == "de"
    assert odd[1].text_language is None and len(odd) == 7


def named(rows, training):
    """By brute force: (id, language, text_language, posterior) of rows (id, text, declared, host), from training rows (text, lang)."""
    from tessera.llm._ngrams import GRAMS, symbol_table
    from tessera.llm.language_id import ALPHA, EFFECTIVE, PRIOR_WEIGHT, SUFFIXES, TRUST, UNIT

    def grams(text):
        symbols = [0, 0, 0] + [int(symbol_table()[ord(c)]) for c in text or ""]
        return [tuple(symbols[k : k + 4]) for k in range(len(text or ""))]

    labels = Counter(lang for text, lang in training if text is not None and lang is not None)
    names = sorted(labels)
    counts = {name: Counter(g for text, lang in training if lang == name and text is not None for g in grams(text)) for name in names}
    cost = {name: (lambda g, c=c, t=np.log(sum(c.values()) + ALPHA * GRAMS): round(UNIT * (np.log(c[g] + ALPHA) - t))) for name, c in counts.items()}
    scores, shares = [], []
    for _, text, _, _ in rows:
        of = grams(text)
        score = [sum(cost[name](g) for g in of) for name in names]
        scores.append([s * EFFECTIVE // len(of) for s in score] if len(of) > EFFECTIVE else score)
        odds = [np.exp((s - max(scores[-1])) / UNIT) for s in scores[-1]]
        shares.append([round(1000 * o / sum(odds)) if of else 0 for o in odds])
    out = []
    for k, (i, text, declared, host) in enumerate(rows):
        declared = (re.match("[A-Za-z]+", declared or "") or [""])[0].lower()
        host = host and host.lower()
        suffix = host and host.split(".")[-1]
        domain = host and ".".join(host.split(".")[-2:]) if host and "." in host else ""
        ends = lambda h: (h.lower().split(".")[-1], ".".join(h.lower().split(".")[-2:]) if "." in h else "", h.lower())
        prior = [1 / len(names)] * len(names)
        levels = [lambda h: True] + ([lambda h: h and ends(h)[0] == suffix, lambda h: h and ends(h)[:2] == (suffix, domain), lambda h: h and h.lower() == host] if host is not None else [])
        for inside in levels:
            n = [sum(shares[j][m] for j, r in enumerate(rows) if j != k and inside(r[3])) / 1000 for m in range(len(names))]
            prior = [(x + PRIOR_WEIGHT * p) / (sum(n) + PRIOR_WEIGHT) for x, p in zip(n, prior)]
        logs = [s / UNIT + np.log(p) for s, p in zip(scores[k], prior)]
        for vote, trust in ((declared, TRUST["declared"]), (SUFFIXES.get(suffix), TRUST["suffix"])):
            if vote in names:
                logs = [x + np.log(trust if name == vote else (1 - trust) / (len(names) - 1)) for x, name in zip(logs, names)]
        best = max(range(len(names)), key=lambda m: logs[m])
        out.append((i, names[best], names[max(range(len(names)), key=lambda m: scores[k][m])] if text else None, 1 / sum(np.exp(x - logs[best]) for x in logs)))
    return out


def test_language_id_against_brute_force(spark):
    r = np.random.default_rng(8)
    words = {"de": "der die und nicht eine über".split(), "fr": "le la les être une où".split(), "en": "the and of a not over".split()}
    text = lambda lang, n: " ".join(r.choice(words[lang], n))
    training = [(text(lang, 20), lang) for lang in words for _ in range(50)] + [(text("de", 9), "dirty"), (None, "en"), ("x", None)]
    hosts = [None, "a.site.de", "b.site.de", "c.other.de", "x.fr", "W.Big.com", "w.big.com", "local"]
    rows = [(k, [text(["de", "fr", "en"][k % 3], 1 + k % 7), None, ""][0 if k % 5 else 1 + k % 2], [None, "de-AT", "FR", "xx", "en"][r.integers(5)], hosts[r.integers(8)]) for k in range(60)]
    rows += [(900, text("fr", 3), None, "alone.fr"), rows[1], (1, "le la", None, "a.site.de")]
    table = spark.createDataFrame(rows, "id long, text string, declared string, host string").withColumns({"share": F.lit(1), "suffix": F.lit("q"), "n": F.lit(0)})
    got = identify(table, spark.createDataFrame(training, "text string, lang string").withColumn("gram", F.lit(1))).collect()
    key = lambda t: (t[0], str(t[1]), str(t[2]), t[3])
    for g, e in zip(sorted((tuple(g)[:4] for g in got), key=key), sorted(named(rows, training), key=key), strict=True):
        assert g[:3] == e[:3] and abs(g[3] - e[3]) < 2e-5, (g, e)


def test_rare_languages_count(spark, documents):
    """One document of a language among a thousand names its texts, by text alone, markup and address."""
    words = "che non una sono della con per anche questo perché gli dalla nella molto".split()
    r = np.random.default_rng(11)
    prose = lambda n: " ".join(r.choice(words, n))
    rare = spark.createDataFrame([(prose(300), "it")], "text string, lang string")
    training = documents.select("text", "lang").unionByName(rare)
    rows = [(i, prose(12), [None, "it"][i % 2], [None, "x.it"][i % 2]) for i in range(20)] + [(99, documents.filter("lang = 'en' and n_chars > 200").first().text, None, None)]
    got = {x.id: (x.language, x.text_language) for x in identify(spark.createDataFrame(rows, "id long, text string, declared string, host string"), training).collect()}
    assert got == {i: ("it", "it") for i in range(20)} | {99: ("en", "en")}


def test_batches_of_languages(documents):
    """Small batches give what one gives."""
    rows = documents.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    whole = order(tuple(x) for x in identify(rows, documents).collect())
    assert order(tuple(x) for x in identify(rows, documents, batch_bytes=5000).collect()) == whole


def test_host_prior_decides_without_text(spark, documents):
    french = documents.filter("lang = 'fr'").limit(30).select("doc_id", "text")
    rows = french.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.lit("w.site.org").alias("host"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None, None, "w.site.org"), (-2, None, None, "v.site.org")], "id long, text string, declared string, host string"))
    got = {r.id: r.language for r in identify(rows, documents).collect()}
    assert got[-1] == "fr" and got[-2] == "fr"


def test_revisits(spark):
    record = "record_id long, record_type string, url string, date timestamp, etag string, last_modified string, headers map<string,string>, payload_sha256 string"
    t = lambda h: __import__("datetime").datetime(2024, 1, 1, h)
    repeated = (11, "revisit", "http://a.org/x?a=1&b=2", t(9), None, "m2", None, None)
    rows = [
        repeated, repeated,
        (1, "response", "https://elsewhere.org", t(2), "x", "y", None, "p0"),
        (2, "response", "https://a.org/x?a=1&b=2", t(3), '"f"', "m2", None, "p2"),
        (1, "response", "HTTP://www.A.org:80/x/?b=2&a=1#f", t(1), '"e"', "m1", {"etag": '"e"', "age": "1", "content-type": "t"}, "p1"),
        (2, "response", "https://a.org/x?a=1&b=2", t(3), '"f"', "m2", None, "p2"),
        (3, "response", "https://a.org/x?a=1&b=2", t(3), '"g"', "m2", None, "p3"),
        (4, "revisit", "http://a.org/x?a=1&b=2", t(2), 'W/"e"', None, {"age": "9", "content-length": "0"}, None),
        (5, "revisit", "http://a.org/x?a=1&b=2", t(4), '"e"', None, None, "own"),
        (6, "revisit", "http://a.org/x?a=1&b=2", t(1), None, None, None, None),
        (7, "revisit", "http://a.org/x?a=1&b=2", t(9), None, "m2", None, None),
        (8, "revisit", None, t(9), None, None, None, None),
        (9, "revisit", "http://a.org/x?a=1&b=2", None, None, None, None, None),
        (10, "revisit", "http://a.org/x?a=1&b=2", t(8), None, None, None, None),
    ]
    table = spark.createDataFrame(rows, record).withColumns({"salt": F.lit(1), "bucket": F.lit(2), "here": F.lit(3), "status": F.lit("s")})
    found = resolve_revisits(table).collect()
    assert len(found) == 9
    got = {r.record_id: r for r in found}
    assert {i: (r.response_id, r.status, r.payload_sha256) for i, r in got.items()} == {
        4: (1, "resolved", "p1"), 5: (2, "mismatch", "own"), 6: (None, "missing", None), 7: (2, "resolved", "p2"), 8: (None, "missing", None), 9: (None, "missing", None),
        10: (2, "unvalidated", "p2"), 11: (2, "resolved", "p2"),
    }
    assert got[4].headers == {"etag": '"e"', "age": "9", "content-type": "t"}
    urls = spark.createDataFrame([("HTTPS://www.X.de:443/a//?q#z",), ("not a url#x",), (None,)], "u string")
    assert [r[0] for r in urls.select(canonical_url(F.col("u"))).collect()] == ["http://x.de/a?q", "not a url", None]


def test_empty_tables(spark, nothing):
    bpe, ranks = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.tiktoken")
    empty = [remove_repeats(nothing), near_duplicates(nothing), pack_documents(nothing, ranks), encode_documents(nothing, bpe), quality(nothing), remove_boilerplate(nothing), section_tokens(nothing, ranks)]
    vectors = spark.createDataFrame([], "vec_id long, vector array<long>")
    rows = spark.createDataFrame([], "id long, text string, declared string, host string")
    empty += [top_k(vectors, vectors), identify(rows, nothing), resolve_revisits(spark.createDataFrame([], "record_id long, record_type string, url string, date timestamp, etag string, last_modified string, headers map<string,string>, payload_sha256 string"))]
    assert [e.count() for e in empty] == [0] * len(empty)
