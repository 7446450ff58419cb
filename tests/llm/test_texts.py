"""Text operators: against references, brute force, round trips and held-out accuracy."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import canonical, harmful, lookalikes as K, packing, tokens

need_vocabulary = pytest.mark.skipif(not __import__("os").path.exists(f"{tokens.TOKENIZER_FOLDER}/{tokens.BYTE_BPE}"), reason="no tokenizer files")


# --- plain forms -----------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["km²", "Anteil ½ Tag", "Marke™", "Склад №3", "2019–2021 écart", "Client’s", "📊 Übersicht", "Θερμοκρασία", "Widerstand Ω", "Δ T", "在庫リスト", "IT-отдел", "👩‍💻 ❤️", "", None, "می‌خواهم", "ª º"])
def test_plain_texts_stay(text):
    assert K.plain(text) == text and K.is_plain(text)


@pytest.mark.parametrize(
    "text,want",
    [("ｎｅｔ＿１", "net_1"), ("Café", "Café"), ("a​b­c﻿", "abc"), ("a b　c\td", "a b c d"), ("ﬁeld", "field"), ("Ω", "Ω"), ("Kg", "Kg"), ("µm", "μm"), ("Сarbоn", "Carbon"), ("ΑΒb", "ABb"), ("売上ﾃﾞｰﾀ", "売上データ"), ("Oстаток", "Остаток"), ("Νοta", "Nota"), ("Ⅳ", "IV"), ("x‑y", "x-y")],
)
def test_plain_form(text, want):
    text = {"Ω": "Ω", "Kg": "Kg"}.get(text, text)
    assert K.plain(text) == want and not K.is_plain(text)
    assert K.plain(want) == want


def test_every_disguise_comes_back():
    rng = random.Random(1)
    back = {v: [k for k, x in K.SKELETON.items() if x == v and K.script(k) in ("CYRILLIC", "GREEK")] for v in K.SKELETON.values()}
    for word in ["net_amount", "Échéance de livraison", "Körpermasseindex", "heart rate"] * 40:
        out = ""
        for c in word:
            r = rng.random()
            out += rng.choice(back[c]) if r < 0.2 and back.get(c) else unicodedata.normalize("NFD", c) if r < 0.4 else chr(ord(c) + 0xFEE0) if r < 0.5 and "!" < c < "~" else c
            out += rng.choice("​‌⁠­") if rng.random() < 0.1 else ""
        words = K.spellings([word])
        got = K.plain(out, words)
        if any(ch in out for ch in word):  # at least a letter of its own script
            assert unicodedata.normalize("NFC", got) == got and K.is_plain(got) or len({K.script(c) for c in got} - {None}) > 1
        if all(K.script(c) != "GREEK" or True for c in out) and got != word:
            # a word all of whose letters were exchanged for one other script is plain as it is
            assert any(K.scripts_of(w) and "LATIN" not in K.scripts_of(w) for w in got.replace("_", " ").split())


def test_automaton_costs():
    words = K.spellings(["carbon"], 1)
    assert words.nearest("сarbоn") == "carbon" and words.nearest("carbo​n") == "carbon" and words.nearest("carbn") == "carbon" and words.nearest("crbn") is None
    assert K.spellings(["carbon"]).nearest("carbn") is None and K.spellings([]).nearest("x") is None
    assert K.spellings(["rn", "rm"], 1).nearest("rx") is None  # two equally near


def test_plain_table(spark, collected):
    df = spark.createDataFrame([(1, "ａ", "c"), (1, "ａ", "d"), (2, None, None), (3, "x" * 200_000 + "​", "e")], "id bigint, plain string, is_plain string")
    got = K.with_plain(df, "id", "plain", [])
    assert got.columns == ["record_id", "text", "plain", "is_plain"] and [(r.record_id, r.is_plain) for r in got.orderBy("record_id").collect()] == [(1, False), (1, False), (2, True), (3, False)]
    assert K.with_plain(df.limit(0), "id", "plain", []).count() == 0


# --- canonical names ----------------------------------------------------------------------------------


def test_mapped(spark):
    terms = spark.createDataFrame([(1, "net_amount", ["montant_net"]), (2, "tax_rate", None), (None, "x", None)], "term_id bigint, term string, aliases array<string>")
    listed = canonical.term_list(terms)
    df = spark.createDataFrame([(1, "Net Amount", 0), (2, "odd", 0), (3, None, 0), (4, "odd", 0), (5, "", 0)], "id int, value string, _term int")
    got = canonical.mapped(df.withColumnRenamed("_term", "extra"), listed)
    assert sorted((r.id, r.term_id) for r in got.collect()) == [(1, 1), (2, 0), (4, 0), (5, 0)]
    assert sorted((r.value, r.n) for r in canonical.unmatched(got).collect()) == [("", 1), ("odd", 2)]
    with pytest.raises(ValueError, match="more than"):
        canonical.term_list(terms, 1)
    assert canonical.mapped(df.limit(0), listed).count() == 0


# --- tokens ---------------------------------------------------------------------------------------------


@need_vocabulary
def test_tokens_are_the_library(spark):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(f"{tokens.TOKENIZER_FOLDER}/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    rng = random.Random(2)
    alphabet = " \n\t ab'stlrevdm1²½é漢ー.,!-_😀​́　 '"
    texts = ["", "it's we'll 'sx ''s don't've", "<|endoftext|>", " " * 50, "a" * 3000, "'s" * 50, "x\r\n\r\n  y"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    own = tokens.tokenizer()
    got = [ids for ids, _ in own.encode_batch(texts)]
    assert got == [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(g) for g in got] == texts
    df = spark.createDataFrame([(n, t, None) for n, t in enumerate(texts[:50])] + [(99, None, None)], "doc_id bigint, text string, ids string")
    rows = {r.doc_id: r.ids for r in tokens.encode_column(df).collect()}
    assert rows[99] == [] and rows[0] == [] and all(rows[n] == got[n] for n in range(50))
    assert {r.doc_id: r.n_tokens for r in tokens.encode_column(df, output="n_tokens").collect()} == {k: len(v) for k, v in rows.items()}
    assert all(len(r.ids) == len(r.offsets) for r in tokens.encode_column(df, output="offsets").collect())
    assert tokens.encode_column(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 256])
def test_scan_is_the_pattern(block):
    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab 1'slv\n.　") for _ in range(rng.randint(0, 25))) for _ in range(500)]
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    got = tokens.piece_starts(points, starts[lengths > 0], block).tolist()
    assert got == [s + m.start() for t, s in zip(texts, starts.tolist()) for m in pattern.finditer(t)]


# --- packing -----------------------------------------------------------------------------------------------


def test_plan_places_all():
    rng = random.Random(3)
    for capacity in (1, 7, 64, 1024):
        for _ in range(30):
            sizes = [min(capacity, 1 + int(rng.expovariate(8 / capacity))) for _ in range(rng.randint(0, 400))]
            histogram = {s: sizes.count(s) for s in set(sizes)}
            runs, n = packing.plan(histogram, capacity)
            load, ranks = {}, {s: [] for s in histogram}
            for r in runs:
                for k in range(r.first, r.stop):
                    ranks[r.size].append(k)
                    c = r.container + (k - r.first) // r.per
                    load[c] = load.get(c, 0) + r.size
            assert all(sorted(v) == list(range(histogram[s])) for s, v in ranks.items())
            assert not load or max(load.values()) <= capacity and set(load) == set(range(1, n + 1))
            if sizes:  # never more than one container over 17/10 of the least, as first fit
                assert n <= 1.7 * -(-sum(sizes) // capacity) + 1
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_pack(spark):
    rng = random.Random(4)
    rows = [(n, rng.choice([None, 0, 5, 5, 5, 30, 64, 65, 200])) for n in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    for cell in (500_000, 10):
        got = packing.pack(df, 64, cell).collect()
        assert len({(r.doc_id, r.piece_no) for r in got}) == len(got)
        total, load = {}, {}
        for r in got:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert total == {n: s or 0 for n, s in rows} and max(load.values()) <= 64
        assert all(r.piece_no == 0 for r in got if (dict(rows)[r.doc_id] or 0) <= 64)
    one = packing.fill(packing.pack(df, 64), 64).first()
    assert one.containers >= one.least_containers and one.fill_rate > 0.9
    assert packing.pack(df.limit(0)).count() == 0 and packing.fill(packing.pack(df.limit(0))).first().containers == 0


def test_the_trie_decides_before_the_table():
    """Words of look-alikes alone: the table takes them for Latin, the vocabulary knows better."""
    known = K.spellings(["хор", "сорт вес", "Τιμή κατά"])
    for mixed, want, table in (("xоp", "хор", "xop"), ("Xоp", "Хор", "Xop"), ("x\u200bоp", "хор", "xop")):
        assert K.plain(mixed) == table and K.plain(mixed, known) == want and not K.is_plain(mixed, known)
    assert K.plain("xop", known) == "xop" and K.plain("хор", known) == "хор"  # of one script: both are plain
    near = K.spellings(["amount"], 1)
    assert near.nearest("аmоunt") == "amount" and near.nearest("аmоumt") == "amount" and K.spellings(["amount"]).nearest("аmоumt") is None


# --- harmful content -----------------------------------------------------------------------------------------


def corpus(rng, n):
    """Documents with neutral sentences; some with an insult, often in disguise."""
    neutral = ["The {a} opens the gate {b}.", "The {a} counts parcels {b}.", "See table {n}.", "We thank the {a} {b}.", "Rain fell {b}."]
    bad = ["You are a filthy {i} and nobody likes you.", "Shut your mouth, you {i}.", "I will hurt you, {i}, wait for it."]
    out, y = [], []
    for _ in range(n):
        s = [rng.choice(neutral).format(a=rng.choice(["choir", "baker", "teacher", "museum"]), b=rng.choice(["today", "at night", "in spring"]), n=rng.randint(1, 99)) for _ in range(rng.randint(1, 4))]
        harm = rng.random() < 0.3
        if harm:
            word = rng.choice(["parasite", "moron", "scumbag", "idiot"])
            k = rng.randrange(1, len(word) - 1)
            word = rng.choice([word, word[:k] + "*" + word[k + 1 :], word[:k] + word[k] * 4 + word[k:], word.replace("i", "1").replace("o", "0"), word.upper()])
            s.insert(rng.randint(0, len(s)), rng.choice(bad).format(i=word))
        out.append(" ".join(s))
        y.append(int(harm))
    return out, y


def tables(spark, texts, y, extra=()):
    docs = spark.createDataFrame([(n, t, "web" if n % 2 else None, "x") for n, t in enumerate(texts)] + list(extra), "doc_id bigint, text string, source string, score string")
    reviews = spark.createDataFrame([(n, int(v), "r", None) for n, v in enumerate(y)], "doc_id bigint, is_harmful int, reviewer string, labelled_at timestamp_ntz")
    return docs, reviews


def test_classifier_finds_held_out_insults_despite_wrong_labels(spark):
    rng = random.Random(4)
    texts, y = corpus(rng, 300)
    noisy = [1 - v if rng.random() < 0.06 else v for v in y]
    model = harmful.train(*tables(spark, texts, noisy), landmarks=80)
    more, truth = corpus(rng, 400)
    found, truth = np.array(model.score(more)) > 0, np.array(truth, bool)
    assert (found & truth).sum() / max(1, found.sum()) > 0.9 and (found & truth).sum() / truth.sum() > 0.9
    assert model.score([None, "", "  \n"]) == [-1.0] * 3 and len(model.score(["word " * 100_000])) == 1


def test_folded_machine_is_the_kernel():
    strings = [harmful.normal(s) for s in ["you are a moron", "see the table", "shut up, m0ron!!", "a"]]
    f = harmful.features(strings)
    k = harmful.gram(f, f, width=2, places=7)
    for j in range(len(strings)):
        one = np.zeros(len(strings))
        one[j] = 1
        assert np.allclose(harmful.project(f, harmful.fold(f, one)), k[:, j], atol=1e-5)
    assert np.allclose(k, k.T, atol=1e-5) and k[0, 2] > k[0, 1]


def test_landmarks_lie_apart():
    f = harmful.features([harmful.normal(x) for x in ["the gate is open"] * 3 + ["the gate is open now", "du bist dumm"]])
    k = harmful.gram(f, f)
    assert len(harmful.spread(k, 5)) == 3 and 4 in harmful.spread(k, 2)


def test_harmful_tables(spark, tmp_path):
    texts, y = corpus(random.Random(8), 60)
    docs, reviews = tables(spark, texts, y[:50], [(98, None, None, None), (99, "", "web", None)])
    reviews = reviews.union(spark.createDataFrame([(0, 1 - y[0], "s", None), (97, 1, "r", None), (1, None, "q", None)], reviews.schema))
    cut = harmful.labelled_sentences(docs, reviews)
    assert cut.select("doc_id").distinct().count() == 49 and harmful.labelled_sentences(docs, reviews, 10).select("doc_id").distinct().count() == 10
    key = str(tmp_path).replace("/", "-")
    model = harmful.saved_model(docs, reviews, key)
    again = harmful.saved_model(docs.limit(0), reviews, key)  # read, not trained
    assert (model.weights == again.weights).all() and model.threshold == again.threshold
    got = harmful.score_documents(docs, model)
    assert got.count() == 62 and {r.doc_id: r.score for r in got.where("doc_id > 97").collect()} == {98: -1.0, 99: -1.0}
    r = {x.source: x.documents for x in harmful.rates(got).collect()}
    assert r == {None: 31, "web": 31}
    assert harmful.score_documents(docs.limit(0), model).count() == 0
    twice = reviews.unionByName(reviews.withColumn("reviewer", F.lit("again")))
    q = harmful.quality(docs, twice, 80).first()
    # forty-nine documents train little; the figures themselves must fit together
    assert q.documents == 49 and q.harmful == 15 and q.precision == q.right / q.found and q.recall == q.right / q.harmful > 0.7
    one = tables(spark, ["x"], [1])
    assert harmful.quality(one[0], one[1]).first().documents == 0
    assert harmful.train(*one).score(["x"])[0] <= 0 and harmful.train(one[0], one[1].limit(0)).score(["x"])[0] <= 0
