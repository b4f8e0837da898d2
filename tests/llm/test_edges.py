"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import bpe, decontaminate, line_dedup, lm_score, quality, quotes, simhash, token_files, toxicity
from quarry.llm import queries as Q
from quarry.llm.common import Scratch

from . import brute

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
SHARED = "This line is shared by many documents, all the same."
EXTRA = {"n_lines": pa.int64(), "n_words": pa.string(), "hit_items": pa.int64(), "component_id": pa.string(),
         "n_tokens": pa.int64(), "score": pa.float64(), "fp": pa.int64(), "text_hash": pa.int64(), "d": pa.int64()}


def documents():
    rnd = random.Random(3)
    words = ["the", "of", "réeux", "Ünï", "x9", "don't", "a", "bleat", "ΣΑΣ", "日本"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(None, "a text without an id"), (None, None), (5, None), (6, ""), (7, " \n\t\n "), (8, "w" * 300_000),
            (9, "\n".join(say(9) for _ in range(4000))), (10, say(50)), (10, say(60)), (11, SHARED), (11, SHARED),
            (12, f"x\n  {SHARED.upper()}\t\r\ny"), (13, f"{SHARED}\n{SHARED}\nown"), (14, f"{SHARED}"),
            (15, f"{say(30)} {PASSAGE.upper()}, {say(20)}"), (16, PASSAGE), (17, "short item!"), (18, "Short  ITEM here"),
            (19, "<|endoftext|> in <|startoftext|>text  twice\n\n spaced"), (20, "a  b   c \n d\x1ce\x85f")]
    rows += [(100 + k, say(40)) for k in range(30)]
    rows += [(200 + k, rows[-1][1]) for k in range(5)]
    return rows


def write(folder, name, columns):
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")


def tables(folder, docs, empty=False):
    ids, texts = zip(*docs) if docs else ((), ())
    write(folder, "documents", {
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * len(ids), pa.string()),
        "source": pa.array([None] * len(ids), pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
        **{c: pa.nulls(len(ids), t) for c, t in EXTRA.items()}})
    items = [] if empty else [(1, PASSAGE), (1, PASSAGE), (2, "short item"), (None, "own"), (3, None), (4, "!!")]
    write(folder, "benchmark", {"item_id": pa.array([i for i, _ in items], pa.int64()),
                                "text": pa.array([t for _, t in items], pa.string())})
    known = [] if empty else [(10, 1, 0), (10, 1, 1), (11, 0, 1), (None, 1, 1), (101, None, None), (102, 1, 0), (103, 0, 1)]
    write(folder, "labels", {"doc_id": pa.array([k[0] for k in known], pa.int64()),
                             "quality": pa.array([k[1] for k in known], pa.int32()),
                             "toxic": pa.array([k[2] for k in known], pa.int32())})
    vecs = [] if empty else [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (50, [0.1, 0.1]), (1, None), (2, [1.0, None]),
                             (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, [1.0, 0.5]), (5, [1.0, 0.5]), (6, [-1.0, 0.0]),
                             (None, [1.0, 1.0]), (7, []), (100, []), (8, [0.3, 0.2, 0.1]), (9, [1.0, 0.5]), (10, [1.0, 0.5])]
    write(folder, "embeddings", {"vec_id": pa.array([v[0] for v in vecs], pa.int64()),
                                 "embedding": pa.array([v[1] for v in vecs], pa.list_(pa.float32())),
                                 "label": pa.nulls(len(vecs), pa.int32())})
    says = [] if empty else [(1, 0, "u", "Hello\n\nthere"), (1, 1, "a", None), (1, 2, "u", ""), (1, 3, "a", "Hello\n\nthere"),
                             (1, 3, "a", "Hello\n\nthere"), (1, 4, "u", "Again " * 20_000), (None, 0, "u", "x"), (2, None, "u", "y"),
                             (3, 7, None, "late start")]
    write(folder, "conversations", {"conv_id": pa.array([s[0] for s in says], pa.int64()), "turn": pa.array([s[1] for s in says], pa.int64()),
                                    "role": pa.array([s[2] for s in says], pa.string()), "text": pa.array([s[3] for s in says], pa.string())})
    return str(folder)


@pytest.fixture(scope="module")
def docs():
    return documents()


@pytest.fixture(scope="module")
def odd(tmp_path_factory, docs):
    return tables(tmp_path_factory.mktemp("odd"), docs)


@pytest.fixture(scope="module")
def none(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("none"), [], empty=True)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables_give_empty_results(spark, none, name):
    df = Q.QUERIES[name](spark, none)
    assert df.columns and df.count() == 0


def test_pipeline_on_empty_and_odd_tables(spark, none, odd):
    assert corpus_pipeline.run(spark, none).count() == 0
    kept = [r["doc_id"] for r in corpus_pipeline.run(spark, odd).collect()]
    assert 16 not in kept and len(kept) == len(set(kept) | {None}) - (None not in kept)


def test_op3(spark, odd, docs):
    holders = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(brute.AZ)
            if len(key) >= 20:
                holders.setdefault(key, set()).add(d)
    want = Counter()
    for d, text in docs:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            own = holders.get(line.strip(" \t\n\x0b\x0c\r").translate(brute.AZ), set())
            if len(own) < 3 or d == max((x for x in own if x is not None), default=None):
                kept.append(line)
        want[d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert rows_of(Q.QUERIES["op3_line_dedup"](spark, odd)) == want


def test_op4(spark, odd, docs):
    want = Counter()
    for d, text in docs:
        one = brute.decontaminate([{"doc_id": d, "text": text}], [
            {"item_id": i, "text": t} for i, t in [(1, PASSAGE), (2, "short item"), (None, "own"), (3, None), (4, "!!")]])
        want[(d, *one[d])] += 1
    assert rows_of(Q.QUERIES["op4_decontaminate"](spark, odd)) == want


def test_op4_in_blocks_equals_one_block(spark, odd, monkeypatch):
    d = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text")
    b = spark.read.parquet(f"{odd}/benchmark.parquet")
    one = rows_of(decontaminate.scan(d, b).selectExpr("doc_id", "n_words", "to_json(hit_spans)", "to_json(hit_items)"))
    monkeypatch.setattr(decontaminate, "BLOCK_SEGMENTS", 2)
    many = rows_of(decontaminate.scan(d, b).selectExpr("doc_id", "n_words", "to_json(hit_spans)", "to_json(hit_items)"))
    assert one == many


def test_op4_cuts_passages_out(spark, odd):
    d = spark.read.parquet(f"{odd}/documents.parquet")
    left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(
        d, spark.read.parquet(f"{odd}/benchmark.parquet"), remove="spans").collect()}
    assert left[16] == "" and "GAMMA" not in left[15] and left[17] == "!"


def test_op5(spark, odd, docs):
    fps = [(d, brute.simhash(t)) for d, t in docs]
    groups = brute.groups([(k, fp) for k, (_, fp) in enumerate(fps)])
    least = {}
    for k, (d, _) in enumerate(fps):
        if d is not None:
            least[groups[k]] = min(d, least.get(groups[k], d))
    want = Counter((d, f"{fp:016x}", least.get(groups[k])) for k, (d, fp) in enumerate(fps))
    assert rows_of(Q.QUERIES["op5_simhash_near_dedup"](spark, odd)) == want
    kept = simhash.dedup_near(spark.read.parquet(f"{odd}/documents.parquet")).count()
    assert kept == len({groups[k] for k in range(len(fps))})


def test_gray_tree_finds_all_links():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << draw.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)])
    fps = np.unique(np.concatenate([base, near, draw.integers(0, 1 << 63, 2000, dtype=np.uint64)]))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    a, b = fps[:1300], fps[1300:]
    for x, y, same in ((a, a, True), (a, b, False)):
        t = simhash.GrayTree(x)
        got = {(int(i), int(j)) for p, q in simhash.links(t, t if same else simhash.GrayTree(y), 3, same) for i, j in zip(p, q)}
        near = np.bitwise_count(x[:, None] ^ y[None, :]) <= 3
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if not same or i < j}
        assert got == want and want


def test_op6(spark, odd, docs):
    words = [(d, (t or "").encode().lower().split() + [None]) for d, t in docs]
    out = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in docs]
    c = Counter(w for (_, ws), o in zip(words, out) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), o, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4))
                  for (d, ws), o in zip(words, out))
    got = Q.QUERIES["op6_lm_scoring"](spark, odd).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)


@pytest.mark.parametrize("name,modulus,held", [("op7_quality_classifier", 4, 2), ("op9_toxicity", 5, 0)])
def test_op7_op9_score_every_row(spark, odd, docs, name, modulus, held):
    got = Q.QUERIES[name](spark, odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in docs)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % modulus == held) for r in got)


def test_op8(spark, odd):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{odd}/embeddings.parquet'")
    got = Q.QUERIES["op8_exact_top_k"](spark, odd).collect()
    by = lambda q: sorted((r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
    # query 0: its five best among rows of its length, ties to smaller ids; row 5 counts twice
    assert by(0) == sorted([(256 * 256 + 128 * 128, i) for i in (5, 5, 9, 10, 50)])
    assert by(100) == [(0, 7)]
    assert len([r for r in got if r["query_id"] == 50]) == 10  # the id names two queries


@pytest.mark.parametrize("query,file,cut", [("op10_bpe", "word_bpe_49k.json", None)])
def test_op10(spark, odd, docs, query, file, cut):
    tk = Tokenizer.from_file(Q.tokenizer_path(file))
    want = Counter()
    for d, t in docs:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert rows_of(Q.QUERIES[query](spark, odd)) == want


def test_op10_equals_the_library_on_odd_text():
    path = Q.tokenizer_path("word_bpe_49k.json")
    tk, own = Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    rnd = random.Random(1)
    draw = [lambda: rnd.randrange(32, 127), lambda: rnd.randrange(0xA0, 0x250), lambda: rnd.randrange(0x250, 0xD7FF),
            lambda: rnd.randrange(0x1F300, 0x1F600), lambda: 32, lambda: 10]
    texts = ["".join(chr(rnd.choice(draw)()) for _ in range(150)) for _ in range(200)]
    texts += ["".join(rnd.choice("ab'sSreLl \n.,!?12Σσςİé́") for _ in range(rnd.randrange(1, 200))) for _ in range(300)]
    texts += ["z" * 5000, "ab" * 400 + "é" * 9]
    for t, got in zip(texts, own.encode([t.encode() for t in texts])):
        assert np.frombuffer(got, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids
        assert own.decode(got).decode() == tk.decode(np.frombuffer(got, "<u4").tolist(), skip_special_tokens=False)


def test_op2(spark, odd, docs):
    tk = Tokenizer.from_file(Q.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in docs:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = Q.QUERIES["op2_token_files"](spark, odd).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))


def test_op2_round_trip_and_random_access():
    draw = np.random.default_rng(0)
    for _ in range(10):
        lengths = draw.integers(1, 200, 50)
        ids = draw.zipf(1.3, lengths.sum()) % 300
        file = token_files.ShardFile(token_files.compress(ids, lengths, 50257))
        assert (np.concatenate(list(file.documents())) == ids).all() and len(file.symbols) < len(ids)
        start = np.cumsum(lengths) - lengths
        for d in range(50):
            lo = int(draw.integers(0, lengths[d]))
            hi = int(draw.integers(lo, lengths[d])) + 1
            assert (file.extract(d, lo, hi) == ids[start[d] + lo:start[d] + hi]).all()


def test_op1_odd_rows(spark, odd):
    got = {(r["conv_id"], r["turn"], r["position"]): r for r in Q.QUERIES["op1_quote_links"](spark, odd).collect()}
    assert got[1, 1, 2]["parent_turn"] == 0 and got[1, 2, 1]["parent_turn"] is None and got[1, 4, 2]["parent_turn"] == 3
    assert got[None, 0, None]["parent_turn"] is None and got[2, None, None]["depth"] == 0 and got[3, 7, 1]["root_turn"] == 7


def test_quotes_parse_and_nested_links(spark):
    passages, own = quotes.parse("> > deep  One\n> > more\n> near\n\nmine\n>> x")
    assert passages == [(2, "deep one more"), (1, "near"), (0, "mine"), (2, "x")] and own == "\nmine"
    rows = [(1, 1, "first words"), (1, 2, "> first words\nsecond"), (1, 3, "first words"), (1, 4, ">> first words\n> second\nthird"),
            (1, 5, "> not said\nfifth")]
    d = {r["turn"]: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert [d[k]["parent_turn"] for k in range(1, 6)] == [None, 1, None, 2, None]
    assert (d[4]["root_turn"], d[4]["depth"], d[4]["position"], d[5]["n_unlinked"]) == (1, 2, 3, 1)


def test_toxicity_folds_disguises_and_spares_phrases():
    assert toxicity.words("1D10T ìdіоt id​iot".encode()) == [b"idiot"] * 3
    lex = toxicity.Lexicon({" kiii ": 3.0, " idi": 2.0, " idiot ": 4.0}, [" kiii  process "])
    found = lambda t: sorted(w for _, w in lex.hits(toxicity.words(t.encode())))
    assert found("kill the idiot") == [3.0, 4.0] and found("kill process idio") == [2.0]
    assert found("") == []


def test_isotonic_is_monotone_and_keeps_means():
    n, s = np.array([1.0, 2, 1, 4]), np.array([1.0, 0, 1, 3])
    fit = quality.isotonic(n, s)
    assert (np.diff(fit) >= 0).all() and math.isclose((fit * n).sum(), s.sum())


def test_line_dedup_keeps_other_columns(spark, odd):
    out = line_dedup.dedup_lines(spark.read.parquet(f"{odd}/documents.parquet"))
    assert out.columns.count("n_lines") == 1 and {"lang", "score", "n_dropped"} <= set(out.columns) and out.count() == len(documents())


def test_op6_counts_beyond_32_bits_keep_their_ratio():
    part = lm_score.pack_counts(np.array([0, 1, 4, 5, 7]), np.array([3 << 32, 1 << 32, 300, 7, 1 << 30]))
    held = lm_score._Held()
    for _ in range(2):  # the sum of two parts, as blocks and the left-out documents' counts are added
        held.add(*lm_score.unpack_counts(part))
    cells, n = held.merge()
    assert cells.tolist() == [0, 1, 4, 5, 7] and n.tolist() == [3 << 33, 1 << 33, 600, 14, 1 << 31]
    assert lm_score.slot_values(n[:1], n[1:2])[0][0] == round(-math.log(3) * lm_score.STEPS)


def test_op6_tables_grow_with_distinct_contexts(spark):
    def bits(words):
        docs = spark.createDataFrame([(k, " ".join(words[k::50])) for k in range(50)], "doc_id long, text string")
        with Scratch(spark) as scratch:
            return lm_score.fit(scratch.stash(lm_score.chunks(docs, 2, 7))).bits
    few, many = (bits([hashlib.md5(str(k).encode()).hexdigest()[:12] for k in range(n)]) for n in (500, 20_000))
    assert max(lm_score.table_bits(n) for n in (1 << 24, 1 << 30)) > 30
    assert many[-1] >= few[-1] + 4 and many[0] <= 17


def test_op6_learns_phrases_across_words(spark):
    rnd = random.Random(4)
    phrase = "the quick brown fox jumps over the lazy dog while seven red boats drift along a quiet river".split()
    mixed = [rnd.sample(phrase, len(phrase)) for _ in range(30)]
    rows = [(k, " ".join(phrase)) for k in range(400)] + [(1000 + k, " ".join(m)) for k, m in enumerate(mixed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits = {r["doc_id"]: r["bits_per_byte"] for r in lm_score.score_documents(docs).collect()}
    fluent = np.mean([bits[k] for k in range(400)])
    assert fluent < 0.8 * np.mean([bits[1000 + k] for k in range(30)])


def test_op2_grammar_is_finished():
    draw = np.random.default_rng(2)
    passage = draw.integers(0, 5000, 500)
    docs = [np.concatenate([draw.integers(0, 5000, 3), passage, draw.integers(0, 5000, 3)]) for _ in range(64)]
    docs += [np.full(n, 7) for n in (1, 2, 3, 9)] + [np.array([8, 8, 8])]
    lengths = np.array([len(d) for d in docs])
    file = token_files.ShardFile(token_files.compress(np.concatenate(docs), lengths, 50257))
    assert all((a == b).all() for a, b in zip(file.documents(), docs))
    assert (file.doc_symbols[:64] <= 7).all() and file.sizes.max() >= 500
    pairs, at = Counter(), 0
    for n in file.doc_symbols.astype(int).tolist():
        own, k = file.symbols[at:at + n].tolist(), 0
        for k in range(n - 1):
            pairs[own[k], own[k + 1]] += own[k] != own[k + 1]
        at += n
    assert max(pairs.values()) < 2


def test_toxicity_folds_soft_hyphens_and_signs_at_word_edges():
    assert toxicity.words("id\u00adiot !diot $hit a$$hole a$$ idiot! id!ot".encode()) == [
        b"idiot", b"idiot", b"shit", b"asshoie", b"ass", b"idiot", b"idiot"]
    assert toxicity.words("idiot!! wait!!what $ !".encode()) == [b"idiot", b"wait", b"what"]
