"""The corpus operators against brute force, round trips, held-out labels and odd inputs."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fleetcost import llm
from fleetcost.llm import chat, fmindex, langid, mih, mixing, packing, quality, simhash, suffix, urls, windows
from fleetcost.llm import similar as similar_
from fleetcost.llm.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, w string, h long"
R = random.Random(5)
WORDS = ["".join(R.choice("abcdefg") for _ in range(R.randint(2, 6))) for _ in range(60)]
SAID = " ".join(R.choice(WORDS) for _ in range(70))


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


#: Null and empty texts, null ids and sources, repeated rows, ids shared by other texts, a periodic text, copies, shared passages.
DOCS = ([(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (None, prose(90), "en", "a"), (4, "ab " * 400, "de", "b"), (5, SAID, "en", "a"), (5, SAID, "en", "a"),
         (6, prose(20) + " " + SAID + " " + prose(20), "en", None), (6, prose(30), None, "b"), (7, SAID + " " + SAID, "de", "b"), (8, "x" * 3000, "en", "a"), (9, "Ünï ç", "de", "a")]
        + [(20 + i, prose(15 + i) + " " + SAID[:200 + 20 * i] + " " + prose(10), "en" if i % 2 else "de", "abc"[i % 3]) for i in range(12)] + [(40 + i, SAID.upper(), "en", "c") for i in range(3)])


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, la, s, 0, 7, "x", 1) for i, t, la, s in rows], SCHEMA).repartition(3)


def same_sql(spark, name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(llm.SQL[name])
    names = [d[0] for d in want.description]
    got = llm.QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(got.columns)
    return sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_same_rows_as_the_sql(spark, sf_dir, name):
    assert same_sql(spark, name, sf_dir)


def brute_quality(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_counts_and_odd_inputs(spark):
    got = quality.quality(frame(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(str, (r[1:6] for r in got))) == sorted(str(brute_quality(t)) for _, t, _, _ in DOCS)
    assert all(not r.kept for r in got if r.base_failed) and not [r for r in got if r.n_words == 0 and not r.base_failed]
    assert quality.quality(frame(spark, [])).count() == 0


def test_chat_folds_events_and_reads_back(spark):
    odd = "a<|im_end|>\\n<|x|>\\\\<\\|\n<|im_start|>assistant ok"
    log = [(1, 1, "delta", "m1", "user", "Hi"), (1, 2, "delta", "m1", None, " there"), (1, 3, None, "m2", "assistant", "wrong"), (1, 4, "regenerate", "m2", None, None),
           (1, 5, "delta", "m2", None, odd), (1, 6, "edit", "m1", None, "Hello"), (1, 7, "delta", "m1", None, "!"), (2, 1, "delta", "m", "as\\n\nsistant", odd), (2, 2, "delta", "n", None, None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg_id string, role string, text string")
    rendered = chat.render(chat.fold(events))
    back = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "Hello!"), ("assistant", odd)] and back[1].learned == [odd]
    assert [tuple(t) for t in back[2].turns] == [("as\\n\nsistant", odd), ("", "")] and back[2].learned == []
    one = rendered.where("conv_id = 1").first()
    assert one.formatted.count(chat.START) == one.n_turns == 2 and one.formatted[one.loss[0].start:one.loss[0].start + one.loss[0].length].startswith("a<\\|im_end|>")
    assert chat.render(chat.fold(events.limit(0))).count() == 0


def test_packing_is_whole_gapless_and_unpadded(spark):
    path = public_tokenizers.path(packing.TOKENIZER)
    tok, docs = Tokenizer.from_file(path), DOCS + [(99, "İ ſ ½ <|endoftext|> 漢字 don't É\u0085x", None, None)]
    p = packing.pack(frame(spark, docs).repartition(5), path, size=128, windows=2, fan_in=2).toPandas()
    want = Counter(tok.encode(t or "", add_special_tokens=False).ids.__len__() + 1 for _, t, _, _ in docs)
    assert sum(p["length"]) == sum(k * n for k, n in want.items())
    single = p[p["doc_id"] == 99].sort_values("start")
    ids = np.array(tok.encode(docs[-1][1], add_special_tokens=False).ids + [1], "<u4").tobytes()
    assert b"".join(single["ids"]) == ids and (single["doc_tokens"] == len(ids) // 4).all()
    p = p.sort_values(["sequence_id", "offset"])
    total = p.groupby("sequence_id")["length"]
    assert (p["offset"] == total.cumsum() - p["length"]).all()
    sizes = total.sum()
    assert all(n == 128 or n & (n - 1) == 0 for n in sizes) and (sizes != 128).sum() <= 7
    assert packing.pack(frame(spark, []), path).count() == 0


def test_encoder_is_the_tokenizer():
    path = public_tokenizers.path(packing.TOKENIZER)
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    pool = "abcXYZ019 .,!?'st re ll\n\t#$%ßÄöÉçñÑœŒİıĸ©®°²½¼ªº«»¿¡×÷\xad\x85 \x1c😀漢字é́"
    for _ in range(1500):
        t = "".join(R.choice(pool) for _ in range(R.randint(0, 40))) + R.choice(["", "<|endoftext|>", "don't I'LL", "\x00"])
        assert enc.ids(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_are_encoded_once_a_process():
    path = public_tokenizers.path(packing.TOKENIZER)
    assert packing.encoder(path) is packing.encoder(path)
    enc, text, long = packing.Encoder(path), "Don't stop, x1! <| ß|\u00e9>", "ab1" * 50
    want, whole = enc.ids(text), enc.ids(long)
    assert whole == np.array(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids, "<u4").tobytes() and long not in enc
    enc.pieces.clear()
    enc.pieces.model = None
    assert enc.ids(text + "\n" + text) == want * 2


def test_language_held_out_accuracy_and_odd_inputs(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learned(docs)
    got = langid.identify(docs.where(langid.held_out("doc_id")), model, carry=("lang",)).where("lang IS NOT NULL").toPandas()
    assert len(got) > 150 and (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    two = docs.where("lang = 'en' AND n_chars > 2000").first().text[:900] + " " + docs.where("lang = 'de' AND n_chars > 2000").first().text[:900]
    odd = langid.identify(frame(spark, [(1, None, None, None), (2, "", None, None), (3, "123 !!", None, None), (4, two, None, None)]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and sorted(odd[3].languages) == ["de", "en"] and abs(sum(odd[3].shares) - 1) < 1e-3
    nothing = langid.fit(frame(spark, [(1, "abc", None, None)]))
    assert [r.lang_pred for r in langid.identify(frame(spark), nothing).select("lang_pred").distinct().collect()] == ["und"]


def test_url_rules_agree_with_a_plain_search(spark):
    hosts, paths = ["a.org", "b.a.org", "x.y.com", "org", "com", "notorg", "a.org:80", ""], ["", "/", "/en/1", "/en/12", "/en/1/x", "/es/", "/es", "/e"]
    urls_ = [f"{s}{h.upper() if n % 2 else h}{p}{q}" for n, (s, h, p, q) in enumerate((s, h, p, q) for s in ("http://", "") for h in hosts for p in paths for q in ("", "?a=/en/", "#x"))] + [None, ""]
    rules = [("org", "/", "allow"), ("a.org", "/en/1", "block"), ("a.org", "/e", "allow"), ("com", "/es/", "block"), ("y.com", "/", "allow"), ("a.org", "/e", "block"), (None, "/", "block"), ("com", None, "block")]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    table = spark.createDataFrame(rules, "host string, path string, action string")

    def plain(url):
        host, path = urls.split_url(url)
        fit = [(h.count(".") + 1, len(p or ""), a == "block", h + (p or ""), a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        return (host, path, *(max(fit)[3:] if fit else (None, "allow")))
    for most in (200_000, 2):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, table, max_rules=most).collect()}
        assert got == {i: plain(u) for i, u in enumerate(urls_)}


def test_mixing_meets_targets(spark):
    docs = frame(spark, [(i, prose(R.randint(1, 40)), "en", "abcd"[min(3, i % 7)]) for i in range(400)] + DOCS)
    a, b = (mixing.mix(docs).toPandas() for _ in range(2))
    rows = lambda d: sorted(map(str, d.itertuples(index=False)))
    assert rows(a) == rows(b) and len(a) == 400 + len(DOCS)
    per = a.assign(source=a["source"].fillna("~")).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(per["taken"] - per["target"]) <= 1).all() and (a["taken"] <= 3 * a["size"]).all() and abs(per["target"].sum() - per["size"].sum()) < 1e-6
    assert (per["target"] <= 3 * per["size"] + 1e-9).all()
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixing_cuts_inside_one_length(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    docs = frame(spark, [(i, "a b c", "en", "s" if i % 4 else "t") for i in range(900)])
    per = mixing.mix(docs).toPandas().groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per["taken"] - per["target"]) < 3).all()


def test_mixing_takes_no_documents_without_words_beyond_whole_copies(spark):
    docs = frame(spark, [(i, "" if i % 2 else "a b c", "en", "s" if i % 4 < 2 else "t") for i in range(80)] + [(100 + i, " ", "en", "u") for i in range(9)])
    rows = mixing.mix(docs).collect()
    assert len(rows) == 89 and all(r.copies == min((x.copies for x in rows if x.source == r.source)) for r in rows if r.size == 0)
    assert all(r.copies == 0 for r in rows if r.source == "u")


@pytest.mark.parametrize("budget", [0, 1, 777, 5000])
def test_subset_sum_is_exact_where_it_can_be(budget):
    sizes, counts = np.arange(1, 60), np.full(59, 9)
    take = mixing.subset_sum(sizes, counts, budget, dp_budget=64)
    assert (take <= counts).all() and (take * sizes).sum() == budget


def components(prints):
    parent = {x: x for x in prints}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, y in combinations(prints, 2):
        if bin(x ^ y).count("1") <= 4:
            parent[find(x)] = find(y)
    return {x: find(x) for x in prints}


def test_simhash_positions_cover_every_four_bytes():
    assert len(simhash.POSITIONS) == 20 and all(any(set(t) <= set(c) for t in simhash.POSITIONS) for c in combinations(range(8), 4))


@pytest.mark.parametrize("large", [20_000, 3])
def test_simhash_links_near_fingerprints(spark, large):
    base = [R.getrandbits(64) for _ in range(4)]
    prints = list({b ^ sum(1 << k for k in R.sample(range(64), R.randint(0, 5))) for b in base for _ in range(40)} | {R.getrandbits(64) for _ in range(100)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    got = connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), large)).collect()
    want, of = components(prints), dict(zip(signed, prints))
    sets = lambda m: sorted(sorted(v) for v in m.values() if len(v) > 1)
    a, b = defaultdict(list), defaultdict(list)
    for r in got:
        a[r.root].append(of[r.node])
    for x, root in want.items():
        b[root].append(x)
    assert sets(a) == sets(b)


def test_simhash_fingerprint_and_odd_inputs(spark):
    text = "Ab c\tD e\x0bF É"
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ("ab c d e", "c d e f", "d e f É")]
    assert simhash.fingerprint(text) % 2**64 == sum((2 * sum(h >> b & 1 for h in hs) > 3) << b for b in range(64))
    assert simhash.fingerprint("A b") % 2**64 == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint(" \n") == simhash.fingerprint(None) == 0
    got = simhash.near_duplicates(frame(spark)).collect()
    assert len(got) == len(DOCS) and {r.component_id for r in got if r.fingerprint == "0" * 16} == {1} and {r.component_id for r in got if r.doc_id in (5, 40, 41, 42)} == {5}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def brute_bytes(rows, size, first):
    seen = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, np.array(xxhash.xxh32_intdigest((rows[k][1] or "").encode()), np.uint32).view(np.int32)))
    for k in order:
        b = (rows[k][1] or "").encode()
        for p in range(len(b) - size + 1):
            seen[b[p:p + size]].append((k, p))
    masks = [bytearray(len((t or "").encode())) for _, t, *_ in rows]
    for v in seen.values():
        head = v[0]
        for k, p in v if len(v) > 1 else ():
            if not first or (p, rows[k][0], rows[k][1]) != (head[1], rows[head[0]][0], rows[head[0]][1]):
                masks[k][p:p + size] = b"\1" * size
    return sorted((str(rows[k][0]), len(m), sum(m), hashlib.sha256(bytes(x for x, y in zip((rows[k][1] or "").encode(), m) if not y)).hexdigest()) for k, m in enumerate(masks))


@pytest.mark.parametrize("group", [500, 2])
@pytest.mark.parametrize("first", [False, True])
def test_suffix_dedup_is_brute_force(spark, first, group):
    got = suffix.dedup(frame(spark), size=100, keep_first=first, group=group).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_bytes - len(r.kept), hashlib.sha256(r.kept).hexdigest()) for r in got) == brute_bytes(DOCS, 100, first)
    assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:])) and suffix.dedup(frame(spark, [])).count() == 0


def brute_words(rows, size):
    low = {}
    rank = lambda i: (i is None, i or 0)
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - size + 1):
            k = tuple(w[p:p + size])
            low[k] = min(low.get(k, rank(i)), rank(i))
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = {q for p in range(len(w) - size + 1) if low[tuple(w[p:p + size])] < rank(i) for q in range(p, p + size)}
        out.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("group", [500, 2])
def test_substring_dedup_is_brute_force(spark, group):
    got = fmindex.dedup(frame(spark), size=20, group=group).collect()
    assert sorted((str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in got) == brute_words(DOCS, 20)
    assert fmindex.dedup(frame(spark, [])).count() == 0


def test_fm_index_counts_and_shortens():
    text = np.array([R.randint(2, 5) for _ in range(300)] + [0])
    index = fmindex.FMIndex(text, 6, np.arange(301), 128)
    for _ in range(200):
        at, n = R.randint(0, 290), R.randint(1, 9)
        l, r = np.array([0]), np.array([index.n])
        for c in text[at:at + n][::-1]:
            l, r = index.extend(l, r, np.array([c]))
        count = lambda p: sum((text[k:k + len(p)] == p).all() for k in range(301 - len(p)))
        assert r[0] - l[0] == count(text[at:at + n])
        if n > 1:
            l, r = index.shorten(l, r, np.array([n - 1]))
            assert r[0] - l[0] == count(text[at:at + n - 1])


def test_top_k_is_brute_force_in_any_blocks(spark):
    codes = [(i, R.getrandbits(64) - 2**63 if i % 3 else 12345 ^ (1 << i % 60)) for i in range(150)] + [(7, 5), (None, 1), (8, None)]
    df = spark.createDataFrame(codes, "id long, code long").withColumn("cb", F.lit("clash"))
    whole = {(i, c) for i, c in codes if i is not None and c is not None}
    for rows in (1 << 20, 40):
        got = mih.top_k(df, df.where("id % 5 = 0"), k=4, code_rows=rows).collect()
        for q, code in [(i, c) for i, c in whole if i % 5 == 0]:
            want = sorted((bin((c ^ code) % 2**64).count("1"), i) for i, c in whole if i != q)[:4]
            assert [(r.distance, r.id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert mih.top_k(df.limit(0), df.limit(0)).count() == 0


def test_components_ignore_loops_and_repeats(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 100), (70, 60), (60, 70), (80, 60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 60: 60, 70: 60, 80: 60}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(frame(spark).select(*corpus_pipeline.COLUMNS)).withColumn("key", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir))
        after = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "language":
            assert not Counter(after) - Counter(before) and {r for r in before if not any(c.isalpha() for c in r[1] or "")} <= set(before) - set(after)
        if name == "near_duplicates":
            groups = defaultdict(list)
            for r, root in zip(before, similar_groups([r[1] for r in before])):
                groups[root].append(r)
            assert len(after) == len(groups) and not Counter(after) - Counter(before)
            assert all(min(x[0] is None or -1 for x in g) is not None and sum((Counter(after) & Counter(g)).values()) >= 1 for g in groups.values())
        if name == "substrings":
            want = [(i, " ".join(k.split())) for (i, _, n, k) in brute_words(before, 50) if k or not n]
            assert sorted((str(r[0]), " ".join((r[1] or "").encode().decode().split())) for r in after) == sorted(want)
        if name == "mixture":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 3
            size = lambda r: len((r[1] or "").split())
            for source in {r[3] for r in before}:
                have, took = (sum(size(r) for r in rows if r[3] == source) for rows in (before, after))
                assert took <= 3 * have
            targets = {r.source: r.target for r in mixing.mix(spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(before)], "doc_id long, text string, lang string, source string, n_chars long")).select("source", "target").distinct().collect()}
            for source, target in targets.items():
                took = sum(size(r) for r in after if r[3] == source)
                assert took <= target + 1 and took >= 0.9 * target - max((size(r) for r in before if r[3] == source), default=0)
        if name == "packing":
            tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
            tokens = Counter(tuple(tok.encode(r[1] or "", add_special_tokens=False).ids) + (1,) for r in before)
            pieces, sequences, again = docs.toPandas(), defaultdict(int), Counter()
            for at, length in zip(pieces.groupby("sequence_id")["offset"], pieces.groupby("sequence_id")["length"]):
                ends = sorted(zip(at[1], length[1]))
                assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:])) and sum(ends[-1]) <= 2048
            assert pieces["length"].sum() == sum(len(t) * n for t, n in tokens.items())
            for _, g in pieces.groupby("doc_id", dropna=False):
                for start, ids, total in zip(g["start"], g["ids"], g["doc_tokens"]):
                    ids = tuple(np.frombuffer(ids, "<u4").tolist())
                    again[total] += len(ids)
                    assert any(len(t) == total and t[start:start + len(ids)] == ids for t in tokens)
            assert again == Counter({n: sum(len(t) * m for t, m in tokens.items() if len(t) == n) for n in {len(t) for t in tokens}})
    for stage in (f for _, f in corpus_pipeline.STAGES):
        assert stage(spark, frame(spark, []), sf_dir).count() == 0


def test_crc_is_zlibs(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for r in packing.run(spark, sf_dir).limit(40).collect():
        ids = np.array(tok.encode(docs[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
        assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)


def test_clean_documents_are_kept(spark):
    d = "/root/testdata/sf0.01"
    good = quality.quality(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet").where("quality = 1"), "doc_id").toPandas()
    passed = good[~good["base_failed"]]
    assert isinstance(good, pd.DataFrame) and passed["kept"].mean() > 0.99


@pytest.mark.parametrize("sizes, budget, best", [([70_000, 80_000, 90_000], 100_000, 90_000), ([90_000, 95_000], 95_000, 95_000), ([80_000, 90_000, 100_000], 170_000, 170_000),
                                                 ([66_000, 200_000, 300_000], 65_999, 0), ([3, 70_000, 80_000], 150_003, 150_003)])
def test_subset_sum_takes_documents_longer_than_its_table(sizes, budget, best):
    sizes = np.array(sizes)
    take = mixing.subset_sum(sizes, np.ones(len(sizes), np.int64), budget)
    assert (take <= 1).all() and (take * sizes).sum() == best


def test_subset_sum_of_long_documents_is_near_brute_force():
    for _ in range(40):
        sizes = np.array(sorted(R.sample(range(66_000, 400_000), 9)))
        budget = R.randint(60_000, int(sizes.sum()) - 1)
        best = max(s for s in (sum(c) for n in range(10) for c in combinations(sizes.tolist(), n)) if s <= budget)
        take = mixing.subset_sum(sizes, np.ones(9, np.int64), budget)
        assert (take <= 1).all() and 0.998 * best <= (take * sizes).sum() <= best


def test_mixing_takes_long_documents(spark):
    docs = frame(spark, [(i, "a " * n, "en", s) for i, (n, s) in enumerate([(70_000, "a"), (80_000, "a"), (90_000, "a"), (60_000, "b"), (300_000, "c")])])
    per = mixing.mix(docs).toPandas().groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert per.loc["a", "taken"] == 90_000 and (per["taken"] <= per["target"] + 1).all()


def test_chat_keeps_rows_of_repeated_and_null_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "c"), (1, 0, "assistant", "a"), (1, 1, "user", "x"), (1, 1, "user", "x"), (1, None, "assistant", "z"), (1, None, "assistant", None),
            (1, 2, None, "n"), (2, None, "user", "q"), (2, None, "user", "q"), (2, 7, "assistant", "last but not least")]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(chat.events_of(said)))).collect()}
    for conv, r in back.items():
        want = sorted((t is None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [tuple(t) for t in r.turns] == [w[2:] for w in want] and r.learned == [w[3] for w in want if w[2] == "assistant"]


def similar_groups(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, y in combinations(range(len(texts)), 2):
        if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
            parent[find(y)] = find(x)
    return [find(x) for x in range(len(texts))]


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


@pytest.mark.parametrize("common, hold", [(100, 50_000), (5, 50_000), (100, 20)])
def test_similar_documents_are_brute_force(spark, monkeypatch, common, hold):
    monkeypatch.setattr(similar_, "HOLD", hold)
    base = [prose(n) for n in (1, 3, 5, 6, 30, 90, 200, 200, 300)]
    texts = base + [edited(b, R.randint(0, max(1, len(b.split()) // 20))) for b in base for _ in range(12)] + [t for _, t, *_ in DOCS] + [SAID + " " + prose(R.randint(1, 90)) for _ in range(60)]
    texts += [edited(base[-1], R.randint(0, 8)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4).select(F.struct("id", F.lit(0).cast("long").alias("row")).alias("key"), "text")
    met = list(similar_._met(iter(pd.DataFrame({"t": t, "sig": s, "n": 50, "pos": 0}) for t, s in ([[1, 1, 2], [3, 9, 4]], [[2] * 30, range(5, 35)], [[2, 2, 3], [40, 41, 1]], [[3], [8]]))))
    pairs = pd.concat(met)
    assert set(map(tuple, pairs.dropna(subset="u")[["u", "v"]].to_numpy())) == {(3, 9), (1, 8), *((4, v) for v in [*range(5, 35), 40, 41])} and sorted(pairs["sig"].dropna()) == [4, *range(5, 35), 40, 41]
    got, want = {r.key.id: r.component_id.id for r in similar_.similar(docs, common=common).collect()}, similar_groups(texts)
    a, b = defaultdict(set), defaultdict(set)
    for i, root in enumerate(want):
        a[got[i]].add(i)
        b[root].add(i)
    assert sorted(map(sorted, a.values())) == sorted(map(sorted, b.values())) and all(k == min(v) for k, v in a.items())
    assert similar_.similar(docs.limit(0)).count() == 0


def test_pipeline_drops_documents_of_similarity_over_the_bound(spark, sf_dir):
    rows = [(i, prose(150), "en", "a", 1) for i in range(8)]
    rows += [(100 + 10 * i + k, edited(t, 2 + k), "en", "a", 1) for i, t, *_ in rows for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    want = similar_groups([r[1] for r in rows])
    assert sorted(r.doc_id for r in kept) == sorted(rows[k][0] for k in set(want))


def keyed(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4).select(F.struct("id", F.lit(0).cast("long").alias("row")).alias("key"), "text")


def test_near_fingerprints_bring_similar_documents_together(spark, monkeypatch):
    texts = [prose(400) for _ in range(12)]
    texts += [t + " " + t.split()[0] for t in texts]
    prints = [similar_.simhash.vote(similar_.shingles(t, 5).astype(">u8").view(np.uint8).reshape(-1, 8)) for t in texts]
    assert prints[0] == simhash.fingerprint(texts[0], 5) and simhash.vote(np.zeros((0, 8), np.uint8)) == 0
    near = [(i, j) for i, j in combinations(range(len(texts)), 2) if ((prints[i] ^ prints[j]) % 2**64).bit_count() <= simhash.RADIUS]
    assert near and all(j == i + 12 for i, j in near)

    def none(batches):
        for _ in batches:
            yield pd.DataFrame({c: pd.array([], "Int64") for c in ("u", "v", "t", "sig", "n", "pos")})
    monkeypatch.setattr(similar_, "_met", none)
    got = {r.key.id: r.component_id.id for r in similar_.similar(keyed(spark, texts)).collect()}
    assert got == {**{i: i for i in range(24)}, **{j: i for i, j in near}}


def test_pairs_looked_at_grow_with_a_group_of_near_copies(spark, monkeypatch):
    base, r = [f"w{k}" for k in range(150)], random.Random(7)
    def copy():
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.random()}"
        return " ".join(w)
    texts, seen, verified = [copy() for _ in range(600)], [], similar_._verified
    monkeypatch.setattr(similar_, "_verified", lambda source, nodes, pairs, size: (seen.append(pairs.count()), verified(source, nodes, pairs, size))[1])
    groups = []
    for n in (300, 600):
        seen.append(None)
        got = {x.key.id: x.component_id.id for x in similar_.similar(keyed(spark, texts[:n])).collect()}
        want, low = similar_groups(texts[:n]), {}
        for i, root in enumerate(want):
            low.setdefault(root, i)
        assert got == {i: low[root] for i, root in enumerate(want)}
        groups.append(len(low))
    few, many = (sum(x) for x in (seen[1:seen.index(None, 1)], seen[seen.index(None, 1) + 1:]))
    assert many < 12 * 600 and many < 3 * few and 1 < groups[1] < 400


def test_longest_previous_factors_are_brute_force():
    for text in (b"abracadabra" * 5, b"aaaaaaaaaaaaaaaaaaaaaaa", bytes(R.choice(b"ab") for _ in range(200)), b"xyz"):
        n = len(text)
        order = sorted(range(n), key=lambda i: text[i:])
        both = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or text[i + k] != text[j + k]), n)
        lcp = np.array([0] + [both(a, b) for a, b in zip(order, order[1:])])
        got = dict(zip(order, suffix.longest_previous(np.array(order), lcp).tolist()))
        assert got == {i: max((both(i, j) for j in range(i)), default=0) for i in range(n)}
    assert len(suffix.longest_previous(np.array([], np.int64), np.array([], np.int64))) == 0


def test_rows_without_an_id_are_told_apart_where_short_hashes_are_equal(spark):
    """Two texts without an id whose 32-bit hashes are equal, and a third that shares the start of one of them."""
    seen, pair = {}, None
    while pair is None:
        t = "%0280x" % R.getrandbits(1100)
        h = xxhash.xxh32_intdigest(t)
        pair, seen[h] = (seen[h], t) if h in seen else None, t
    rows = [(None, pair[0], None, None), (None, pair[1] + "#" * 100 + prose(40), None, None), (9, pair[0][:260], None, None)]
    got = suffix.dedup(frame(spark, rows), keep_first=False).collect()
    assert sorted((r.n_bytes, r.n_bytes - len(r.kept)) for r in got) == sorted([(280, 260), (len(rows[1][1].encode()), 0), (260, 260)])
    rows = [(None, prose(60), None, None), (None, prose(70) + " " + SAID, None, None), (9, SAID, None, None), (None, prose(60), None, None)]
    got = fmindex.dedup(frame(spark, rows)).collect()
    assert sorted((r.n_words, r.n_words - len(r.kept.split())) for r in got) == sorted([(60, 0), (140, 70), (70, 0), (60, 0)])


def test_long_windows_are_exact_and_too_many_suffixes_an_error(spark):
    rows = [(1, " ".join(str(n) for n in range(500)), None, None), (2, " ".join(str(n) for n in range(90, 400)) + " x " + " ".join(str(n) for n in range(50)), None, None)]
    got = {r.doc_id: r.n_words - len(r.kept.split()) for r in fmindex.dedup(frame(spark, rows), size=200).collect()}
    assert got == {1: 0, 2: 310}
    with pytest.raises(ValueError):
        next(windows.prefix_ranks(np.zeros(1 << 21, np.uint64), 1, 2))


def test_a_vector_of_another_length_is_an_error(spark):
    df = spark.createDataFrame([(1, [1.0] * 65), (2, None), (3, [1.0] * 64)], "id long, v array<float>")
    assert [r.c for r in df.where("id > 1").select(mih.sign_code("v").alias("c")).collect()] == [None, -1]
    with pytest.raises(Exception, match="64 components"):
        df.select(mih.sign_code("v")).collect()


def plain_mixture(model, text, penalty, steps):
    """The mixture of one text by EM written out: words, likelihoods, proportions, the set grown while it pays."""
    grams, first, _ = langid.trigrams([text])
    if not len(first):
        return {}
    ends = [*first[1:], len(grams)]
    words = []
    for a, b in zip(first, ends):
        ll = [sum(float(model.log[g][k]) for g in grams[a:b]) for k in range(len(model.languages))]
        words.append([np.exp(max(x - max(ll), -60)) for x in ll])

    def em(w, rounds):
        for _ in range(rounds):
            share = [[p * q for p, q in zip(w, x)] for x in words]
            w = [sum(s[k] / sum(s) for s in share) / len(words) for k in range(len(w))]
        return w, sum(np.log(max(sum(p * q for p, q in zip(w, x)), 1e-300)) for x in words)
    full, _ = em([1 / len(model.languages)] * len(model.languages), steps)
    order = sorted(range(len(full)), key=lambda k: -full[k])
    best, top = None, -np.inf
    for m in range(1, len(full) + 1):
        w = [full[k] + 1e-6 if k in order[:m] else 0 for k in range(len(full))]
        w, fit = em([x / sum(w) for x in w], 0 if m == 1 else 4)
        if fit - penalty * (m - 1) * np.log(len(words) + 1) <= top:
            break
        best, top = w, fit - penalty * (m - 1) * np.log(len(words) + 1)
    return dict(zip(model.languages, best))


def test_language_mixtures_are_plain_em_and_judged_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.learned(docs)
    texts = [r.text for r in docs.where("lang IS NOT NULL").orderBy("doc_id").limit(24).collect()]
    texts = [t[:400] for t in texts] + [a[:200] + " " + b[:300] for a, b in zip(texts, texts[7:])] + ["", "1 2 3", "a"]
    together, _ = model.mixtures(texts, 3.0, 6)
    for n, t in enumerate(texts):
        want = plain_mixture(model, t, 3.0, 6)
        alone, _ = model.mixtures([t], 3.0, 6)
        assert np.allclose(alone[0], together[n], atol=1e-6)
        assert np.allclose(together[n], [want.get(x, 0) for x in model.languages], atol=2e-3), t[:60]
    rows = [(None, f"Sample text number {n} in some words here", "en", "a") for n in range(300)]
    odd = langid.fit(frame(spark, rows), per_language=100)
    assert odd.languages == ["en"]      # rows without an id are drawn one by one
    assert langid.identify(frame(spark, []), model).count() == 0 and langid.identify(frame(spark, DOCS), model).count() == len(DOCS)


def test_chat_shuffles_texts_once(spark, sf_dir):
    plan = chat.run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = [(None, 1, "user", "a"), (None, None, "assistant", None), (None, None, "assistant", None)]
    df = spark.createDataFrame([(*r, "x", 4) for r in rows], "conv_id long, turn int, role string, text string, kind string, seq int")
    back = chat.read_back(chat.render(chat.fold(chat.events_of(df)))).collect()
    assert [(t.role, t.text) for t in back[0].turns] == [("user", "a"), ("assistant", ""), ("assistant", "")] and len(back) == 1


def test_packing_rebuilds_every_document(spark, sf_dir):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    docs = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = packing.run(spark, sf_dir).toPandas()
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for start, length, crc, total in zip(g["start"], g["length"], g["ids_crc32"], g["doc_tokens"]):
            assert start == at and total == len(docs[i]) and zlib.crc32(np.array(docs[i][at:at + length], "<u4").tobytes()) == crc
            at += length
        assert at == len(docs[i])
    assert set(pieces["doc_id"]) == set(docs)


def test_anchors_of_a_long_text_do_not_depend_on_its_pieces():
    for kind, symbols in ((windows.Kind(windows.Bytes, 20, 9), bytes(R.choice(b"abc") for _ in range(700))), (windows.Kind(windows.Words, 7, 4), [R.choice(b"ab cd ef gh".split()) for _ in range(300)])):
        whole = windows.picks(symbols, kind)
        assert len(whole[0]) > 20
        for piece in (1, 13, 250):
            assert all((a == b).all() for a, b in zip(whole, windows.picks(symbols, kind, piece)))
    assert len(windows.picks(b"short", windows.Kind(windows.Bytes, 20, 9))[0]) == 0


def test_sketches_rule_out_no_similar_sets():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 900, 5000):
        a = rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1)
        for keep in (1.0, 0.95, 0.89, 0.8, 0.5, 0.0):
            b = np.concatenate([a[:int(keep * n)], rng.integers(0, 1 << 63, n - int(keep * n), np.uint64) << np.uint64(1)])
            for other in (b, b[:max(1, int(0.85 * n))], np.concatenate([b, rng.integers(0, 1 << 63, n // 8, np.uint64)])):
                shared, whole = len(np.intersect1d(a, other)), len(np.union1d(a, other))
                said = similar_.may_be_similar(similar_.sketch(np.unique(a)), similar_.sketch(np.unique(other)))
                assert said or 5 * shared < 4 * whole
                assert not (said and n >= 900 and keep <= 0.5)
