"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties,
repeated rows and columns whose names clash with the operators' own; and on empty tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, chat, components, decontaminate, langid, license, linededup, quality, similar, simhash, urlfilter, warc
from corvane.llm.common import new_path, written

DOCS = "doc_id long, text string, lang string, row string, t string, k int"
WORDS = "the of and a to in it is on for with was be by that this from at are as dog house river green seven".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "a b", "a b c d e f " * 40, prose(rng, 80), prose(rng, 9000), "É é ß\x0bx\x0cy\rz\x1fw v\n\n  \nline\nline\nline"]
    base = prose(rng, 120)
    texts += [base, base + " tail", base.upper(), base.replace("the", "teh", 1), prose(rng, 60) + "\n" + prose(rng, 30)]
    rows = [(k, x, ["en", "de", None][k % 3], "r", "t", k) for k, x in enumerate(texts)]
    rows += [rows[6], rows[9], (None, "only words", None, None, None, None), (None, base, None, None, None, None), (3, base, "en", None, None, 1)]
    return spark.createDataFrame(rows, DOCS)


def local(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def space_words(x):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", x or "") if w]


def test_quality(spark, docs):
    def brute(text):
        w = space_words(text)
        seen, places = {}, set()
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                places |= {i + j for i in at for j in range(3)}
        lines = [x for x in (text or "").split("\n") if space_words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(places), len(w) < 50 or 100 * len(places) > 50 * len(w)

    got = local(quality.judge(docs), "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert len(got) == docs.count()
    for text, *found, kept in got:
        assert tuple(found) == brute(text)
        assert not (found[-1] and kept)
    assert quality.kept_rows(docs).columns == docs.columns
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_rules(spark):
    """Each rule is broken by a text made for it; a text of half a million words is measured whole."""
    good = "the house of a green river stands by itself and nobody has seen its old owner since that winter came over hills "
    plain = " ".join(w if w in quality.STOP_WORDS else f"{w}{k}" for k in range(4) for w in good.split())
    texts = {
        "": plain, "stop words": " ".join(f"word{k}" for k in range(400)), "symbols": plain + " ##### ##### #####", "marks": plain + "!" * 80,
        "word length": " ".join("the" + "x" * 20 + str(k) for k in range(90)) + " the", "cut lines": "\n".join(f"the line {k}..." for k in range(40)), "bullets": "\n".join(f"- the a{k} b{k} c{k} d{k}" for k in range(40))}
    df = spark.createDataFrame([(name, x) for name, x in texts.items()], "doc_id string, text string")
    for name, base, broken, kept in local(quality.judge(df), "row.doc_id", "base_failed", "broken", "kept"):
        assert not base and broken == [name] * bool(name) and kept == (not name), name
    long = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(500_000)) + " the of" * 3000)], "doc_id int, text string")
    assert local(quality.judge(long), "n_words", "n_repeat_words", "n_stop_words") == [(506_000, 6000, 6000)]


def test_bpe(spark, docs):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = docs.withColumn("ids", F.lit("x")).select("doc_id", "text", "ids")
    got = bpe.encoded(extra, path, P.PATTERN)
    assert got.columns == ["doc_id", "text", "ids", "ids_"]
    for r in bpe.decoded(got, path, P.PATTERN, "ids_").collect():
        assert r.ids_ == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.round_trip(docs.limit(0), path, P.PATTERN).count() == 0


def test_bpe_tree(monkeypatch):
    import public_tokenizers as P
    import tiktoken

    monkeypatch.setattr(bpe, "LEAF_CHARS", 5)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 3)
    own = bpe.Bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={v: k for k, v in own.bytes.items()}, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "b", "'", "r", "e", "s", " ", " ", "\n", "\t", "é", "ß", "1", "2", "!", "#", "the", "ll", "日本", "\U0001f600", "'re", " 've"]
    for _ in range(5000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = own.encode(x)
        assert ids.tolist() == library.encode_ordinary(x) and own.decode(ids) == x.encode()


def test_bpe_tree_of_documents(monkeypatch):
    """Every text above one leaf is joined from leaves, and the tokens are the library's."""
    import public_tokenizers as P
    import pyarrow.parquet as pq
    import tiktoken

    own = bpe.Bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={v: k for k, v in own.bytes.items()}, special_tokens={})
    joins = []
    met = own._met
    monkeypatch.setattr(own, "_met", lambda *a: joins.append(1) or met(*a))
    texts = [x for x in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if x]
    texts += [" " * 3000, "a" * 3000, "\n \n" * 2000, "'re" * 1500, "x'" * 999 + "re", "日本" * 800]
    for x in texts:
        joins.clear()
        assert own.encode(x).tolist() == library.encode_ordinary(x)
        assert bool(joins) == (len(x) > bpe.LEAF_CHARS)


def brute_fingerprint(text, width=4):
    import xxhash

    w = space_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs):
    got = local(simhash.classes(docs), "id", "fp", "component_id")
    want = [(i, brute_fingerprint(x)) for i, x in local(docs, "doc_id", "text")]
    assert sorted(map(str, ((i, f % 2**64) for i, f, _ in got))) == sorted(map(str, want))
    root = classes_of({f for _, f in want}, lambda a, b: (a ^ b).bit_count() <= 4)
    for _, f, c in got:
        assert c == min((i for i, g in want if i is not None and root[g] == root[f % 2**64]), default=None)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert simhash.classes(docs.limit(0)).count() == 0


def five(text):
    w = space_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar_texts(a, b):
    return bool(a) and len(a & b) >= similar.SIMILARITY * len(a | b)


def test_simhash_similar(spark, docs):
    """Near copies of 0.8 or more, some only just, against comparing all pairs: nearly all are found, and no others."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    texts = []
    for k in range(300):
        n = (45, 120, 400)[k % 3]
        words = [vocabulary[min(int(rng.paretovariate(0.6)), 4999)] for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(1 + k % 2):
            copy = list(words)
            for i in rng.sample(range(n), max(1, round(n * rng.choice([0.005, 0.012, 0.022, 0.03])))):
                copy[i] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(docs.select("doc_id", "text"))
    rows = table.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h1"), F.col("text").alias("t"))
    sets = {h: five(t) for h, t in local(rows, "h1", "t")}
    pairs = [(u, v) for u in sets for v in sets if u < v and similar_texts(sets[u], sets[v])]
    root = dict(local(simhash.similar(rows), "node", "root"))
    found = sum(root.get(u, u) == root.get(v, v) for u, v in pairs)
    assert len(pairs) > 150 and found >= 0.95 * len(pairs)
    near = set(pairs)
    whole = classes_of(sorted(sets), lambda u, v: (min(u, v), max(u, v)) in near)
    assert all(whole[h] == whole[r] for h, r in root.items())
    kept = simhash.deduplicated_similar(table.withColumn("h1", F.lit("h1")).withColumn("row", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "h1", "row"]
    ids = local(kept, "doc_id", "text")
    assert len(ids) == len({root.get(h, h) for h in sets}) and len(set(ids)) == len(ids)
    order = lambda i, h: (i is None, i or 0, h)
    best = {}
    for i, h in local(table.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")), "doc_id", "h"):
        c = root.get(h, h)
        best[c] = min(best.get(c, order(i, h)), order(i, h))
    assert sorted(best.values()) == sorted(order(i, h) for i, h in local(kept.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")), "doc_id", "h"))
    assert simhash.deduplicated_similar(table.limit(0)).count() == 0


def test_simhash_similar_in_a_large_group(spark, monkeypatch):
    """Many near copies of one text, beyond LIMIT and the chunks: one component."""
    rng = random.Random(22)
    words = [f"w{rng.randint(0, 999)}" for _ in range(200)]
    texts = [" ".join(words[:k] + ["zzz", str(k)] + words[k + 2 :]) for k in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "h1 long, t string")
    for limit, chunk in ((4096, 1024), (5, 1024), (4096, 9)):
        monkeypatch.setattr(simhash, "LIMIT", limit)
        monkeypatch.setattr(similar, "CHUNK", chunk)
        assert dict(local(simhash.similar(rows), "node", "root")) == dict.fromkeys(range(150), 0)


def test_simhash_links_are_whole(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(300)}
    chain = centre
    for _ in range(60):  # a chain of close prints, and many around one centre
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(chain)
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)}
    rows = [(p - 2**64 if p >> 63 else p,) for p in prints]
    for chunk in (16384, 16):
        simhash.CHUNK, before = chunk, simhash.CHUNK
        found = simhash.links(spark.createDataFrame(rows, "fp long"))
        got = {r.node: r.root for r in components.connected_components(found, "a", "b").collect()}
        simhash.CHUNK = before
        want = classes_of([r[0] for r in rows], lambda a, b: ((a ^ b) % 2**64).bit_count() <= 4)
        assert {n: got.get(n, n) for n in want} == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2200)] + [(None, 5), (7, 7)]
    got = dict(local(components.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b"), "node", "root"))
    nodes = {x for e in edges for x in e if e[0] is not None and e[0] != e[1]}
    links = {e for e in edges if e[0] is not None}
    want = classes_of(sorted(nodes), lambda a, b: (a, b) in links or (b, a) in links)
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_decontaminate(spark, docs):
    rng = random.Random(7)
    items = [prose(rng, n) for n in (1, 3, 5, 6, 15, 40, 130)] + [None, "", "-- !"]
    long = prose(rng, 20000)
    texts = [items[4].upper(), prose(rng, 300) + " " + items[4] + " " + prose(rng, 300), long + " " + items[5] + ". " + long, items[6].replace("the", "x", 2), items[1], "x " + items[1], " ".join(items[6].split()[:90]), None, ""]
    table = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").union(docs.select("doc_id", "text"))
    bench = spark.createDataFrame(list(enumerate(items)) + [(3, items[3])], "item_id long, text string")
    cut = lambda x: decontaminate.shingles((x or "").encode())
    want = sorted((d, i, len(a & b) / len(b)) for d, x in local(table, "doc_id", "text") for a in [cut(x)] for i, y in local(bench, "item_id", "text") for b in [cut(y)] if b and len(a & b) >= 0.8 * len(b))
    assert len(want) >= 5
    assert sorted(local(decontaminate.contained(table, bench), "id", "item", "containment")) == want
    bad = {x for x in texts if x and any(b and len(cut(x) & b) >= 0.8 * len(b) for b in map(cut, items))}
    clean = decontaminate.clean(table, bench)
    assert sorted(map(str, local(clean, "*"))) == sorted(str(r) for r in local(table, "*") if not any(b and len(cut(r[1]) & b) >= 0.8 * len(b) for b in map(cut, items))) and bad
    assert decontaminate.contained(table, bench.limit(0)).count() == 0 and decontaminate.contained(table.limit(0), bench).count() == 0


def test_decontaminate_pieces(monkeypatch):
    import numpy as np

    rng = random.Random(9)
    texts = [prose(rng, rng.randint(0, 30)).encode() for _ in range(50)] + [b"x" * 100, b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = decontaminate.Hasher()(data, offsets)
    monkeypatch.setattr(decontaminate, "PIECE", 17)
    parts = decontaminate.Hasher()(data, offsets)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_warc(spark):
    rng = random.Random(4)
    big = "".join(rng.choice("abc \r\n") for _ in range(300_000))
    pages = [(1, "http://a/", "x"), (2, None, "x"), (3, "u\r\nv", None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "é", "é\r\n\r\nWARC/1.1\r\n\r\n"), (7, "é", "é\r\n\r\nWARC/1.1\r\n\r\n"), (None, "n", "x"), (None, "n", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("data", F.lit(1)).withColumn("sha", F.lit(2))
    path = new_path(spark, "warc-test")
    warc.write(warc.planned(df), path)
    chunks = warc.read(spark, path)
    got = local(warc.summaries(chunks), "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact")
    name = lambda i: f"urn:corvane:page:{'null' if i is None else i}"
    want = []
    for i, _, html in pages:
        p = (html or "").encode()
        top = max((j for j, _, h in pages if (h or "") == (html or "") and j is not None), default=None)
        again = top is not None and i != top
        want.append((name(i), "revisit" if again else "response", name(top) if again else None, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), True))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert b"".join(bytes(r[1]) for r in sorted(local(chunks.where("record_id like '%:6'"), "chunk", "data"))) == big.encode()
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= warc.CHUNK
    path = new_path(spark, "warc-empty")
    warc.write(warc.planned(df.limit(0)), path)
    assert warc.read(spark, path).count() == 0


def test_warc_common_payload(spark, monkeypatch):
    """A payload that most pages have is one response and many revisits, by broadcast or by shuffle."""
    from corvane.llm import common

    df = spark.createDataFrame([(k, "u", "same" if k % 3 else f"own {k // 6}") for k in range(300)], "page_id long, url string, html string")
    want = {k: max(j for j in range(300) if (j % 3 > 0) == (k % 3 > 0) and (k % 3 or j // 6 == k // 6)) for k in range(300)}
    for hot in (1000, 1):
        monkeypatch.setattr(common, "HOT", hot)
        got = local(warc.planned(df), "record_id", "refers_to")
        assert {int(a.split(":")[-1]): int((b or a).split(":")[-1]) for a, b in got} == want and len(got) == 300


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\l\\\\g", "\\", "a\\", "<<role:x>>", "]]>[", "", None, "line\n<<SYS>>\nend", "\\b[\\", "é[\U0001f600]"]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant", "tool<x>"])]
    rows += [(50, 0, "user", "alone"), (None, 0, "assistant", "x"), (None, None, None, None), (7, 0, "system", nasty[7]), (51, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("conv", F.lit(1))
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    for c in by:
        by[c].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for c, n, turns, chars, loss, _ in local(chat.digests(df), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"):
        said = "".join(x for _, r, x in by[c] if r == "assistant")
        assert n == len(by[c]) and turns == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in by[c]).encode()).hexdigest()
        assert chars == len(said) and loss == hashlib.sha256(said.encode()).hexdigest()
    assert chat.digests(df).count() == len(by)
    examples = local(chat.examples(df), "conv", "example", "text", "start", "length")
    assert len(examples) == sum(r == "assistant" for v in by.values() for _, r, _ in v)
    for _, _, text, start, length in examples:
        assert text.endswith(chat.END) and start - 1 + length + len(chat.END) == len(text)
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_ties_and_long_conversations(spark):
    """Rows of the same turn and role stand in the order of their texts, not of the escaped ones; long ones stay whole."""
    long = "[x] " * 100_000
    rows = [(1, 0, "assistant", "Ab"), (1, 0, "assistant", "<a"), (1, 0, "assistant", "Ab"), (1, 0, "assistant", "]")]
    rows += [(2, k, ["user", "assistant"][k % 2], f"<{k}>") for k in range(4000)] + [(3, 0, "user", long), (3, 1, "assistant", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    said = {1: "<aAbAb]", 2: "".join(f"<{k}>" for k in range(1, 4000, 2)), 3: long}
    got = local(chat.digests(df), "conv_id", "n_turns", "loss_chars", "loss_sha256")
    assert sorted(got) == [(c, n, len(x), hashlib.sha256(x.encode()).hexdigest()) for (c, x), n in zip(said.items(), (4, 4000, 2), strict=True)]


def test_urls(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "/es", "allow"), ("b.net", "", "block"), ("b.net", "", "allow"), (None, "/", "block"), ("c.net", "/x/y", "block")]
    urls = [None, "", "nothing", "http://", "http://example.com", "http://Example.COM/en/x?y#z", "https://www.example.com/en/", "http://badexample.com/en/", "http://x.net/es/1", "http://a.net/es/1", "http://a.net/esx", "http://b.net", "http://q.b.net?x", "http://com/a", "http://c.net/x/yz", "http://c.net/x/", "http://c.net/x/y/z/", "ftp://u:p@example.com:80/en/", "http://c.net//x/y", "http://" + "a." * 3000 + "net/es/" + "x/" * 50_000 + "?q"] * 2
    df = spark.createDataFrame([(k, u, "row") for k, u in enumerate(urls)], "page_id long, url string, row string")

    def brute(u):
        m = re.match(r"([^/?#]*)([^?#]*)", u.partition("://")[2]) if u and "://" in u else None
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    got = local(urlfilter.verdicts(df, urlfilter.rules_frame(spark, rules)), "row.url", "host", "path", "rule", "verdict")
    assert len(got) == len(urls)
    for u, *found in got:
        assert tuple(found) == brute(u), u
    none = urlfilter.verdicts(df, urlfilter.rules_frame(spark, rules).limit(0))
    assert {r[0] for r in local(none, "verdict")} == {"allow"}
    assert urlfilter.verdicts(df.limit(0), urlfilter.rules_frame(spark, rules)).count() == 0


def test_license(spark, docs):
    mit = next(t.words for t in license.TEMPLATES if t.words.startswith("permission"))
    texts = ["MIT License. mit-license; GNU General Public License, apache license cc by", "gnu general public  licence", mit, mit.replace("free of charge", "free of any charge"), "x " * 50 + " ".join(mit.split()[:8]), "apache apache license license", "cc by cc by"]
    df = docs.select("doc_id", "text", "row").union(spark.createDataFrame([(100 + k, x, "q") for k, x in enumerate(texts)] + [(100, texts[0], "q")], "doc_id long, text string, row string"))
    got = local(license.scan(df), "row.text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert len(got) == df.count()
    for text, n, n_base, first, last, base, labels, score in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hits = sorted((i, t.label) for t in license.TEMPLATES if t.base for i in range(len(w)) if w[i : i + len(t.words.split())] == t.words.split())
        assert n == len(w) and n_base == len(hits) and base == ",".join(sorted({x for _, x in hits}))
        assert (first, last) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert set(filter(None, base.split(","))) <= set(filter(None, labels.split(","))) and 0 <= score <= 1
    by = {r[0]: r for r in got}
    assert by[mit][6] == "mit" and by[mit][7] == 1.0 and by[texts[3]][6] == "mit" and not by[texts[4]][6]
    assert license.scan(df.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(8)
    makers = {"en": "the and house river of with".split(), "de": "der und häuser fluss von mit schön".split(), "fr": "le et maison rivière de avec élève".split()}
    rows = [(k, " ".join(rng.choice(makers[name]) for _ in range(30)), name) for k in range(300) for name in [list(makers)[k % 3]]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !?", None), (1003, "x", None), (None, "der und der", None), (None, "le et", "fr"), rows[0], (1004, "der und häuser " * 400_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = local(langid.predict(df, langid.fit(df)), "id", "lang_pred", "score", "rejected")
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert all(by[k][1] == name for k, _, name in rows[:300])
    assert by[1000][1:] == by[1001][1:] == by[1002][1:] == ("und", 0.0, True) and by[1003][1] in makers and by[1004][1] == "de"
    assert all(0 <= r[2] <= 1 for r in got)
    assert langid.fit(df.limit(0)) is None and {r[1] for r in local(langid.predict(df, None), "id", "lang_pred")} == {"und"}
    assert langid.predict(df.limit(0), langid.fit(df)).count() == 0


def test_language_against_brute_force(spark):
    """Document frequencies, sample, centroids, cosines, rejection and ties, recomputed text by text with dictionaries."""
    import zlib
    from collections import Counter
    from math import log, sqrt

    import numpy as np
    import xxhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    twins = spark.createDataFrame([(10_000 + k, "qux zork blip " * 4, name) for k in range(8) for name in ("zz", "aa")], "doc_id long, text string, lang string")
    docs = docs.union(twins)

    def grams(text):
        plain = "".join(chr(c + 32) if 65 <= c <= 90 else chr(c) if 97 <= c <= 122 or c >= 128 else " " for c in text.encode())
        b = b" " + plain.encode("latin-1") + b" "
        codes = [int.from_bytes(bytes([n]) + b[i : i + n], "big") & 0xFFFFFFFF for n in langid.SIZES for i in range(len(b) - n + 1)]
        return Counter((c * 0x9E3779B1 & 0xFFFFFFFF) >> 19 for c in codes)

    rows = local(docs, "doc_id", "text", "lang")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    learned = [(x, name) for i, x, name in rows if x is not None and name is not None and not held[i]]
    frequency = Counter(g for x, _ in learned for g in grams(x))
    idf = {g: log((1 + len(learned)) / (1 + frequency[g])) + 1 for g in range(langid.DIMS)}

    def vector(text):
        v = {g: (1 + log(n)) * idf[g] for g, n in grams(text).items()}
        size = sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    def dot(u, v):
        return sum(x * v.get(g, 0.0) for g, x in u.items())

    def mean(vs):
        total = Counter()
        for v in vs:
            total.update(v)
        size = sqrt(sum(x * x for x in total.values()))
        return {g: x / size for g, x in total.items()}

    centroids = []
    for name in sorted({n for _, n in learned}):
        order = sorted({x for x, n in learned if n == name}, key=lambda x: (h := xxhash.xxh64_intdigest(x.encode(), 42)) - 2**64 * (h >> 63))
        vs = [vector(x) for x in order]
        first = Counter()
        for v in vs:
            first.update({g: x / len(vs) for g, x in v.items()})
        chosen = [first]
        while len(chosen) < min(langid.CENTROIDS, len(vs)):
            chosen.append(min(vs, key=lambda v: max(dot(v, c) for c in chosen)))
        cs = [mean([c]) for c in chosen]
        for _ in range(10):
            near = [max(range(len(cs)), key=lambda j, v=v: dot(v, cs[j])) for v in vs]
            cs = [mean([v for v, k in zip(vs, near, strict=True) if k == j]) if j in near else cs[j] for j in range(len(cs))]
        near = [max(range(len(cs)), key=lambda j, v=v: dot(v, cs[j])) for v in vs]
        for j, c in enumerate(cs):
            own = [dot(v, c) for v, k in zip(vs, near, strict=True) if k == j]
            centroids.append((name, c, (np.quantile(own, langid.QUANTILE) if own else 0) - langid.MARGIN))
    got = local(langid.predict(docs, langid.fit(docs)), "id", "lang_pred", "score", "rejected")
    flags = dict(local(docs.select("doc_id", langid.held_out().alias("h")).distinct(), "doc_id", "h"))
    assert flags == held and len(got) == len(rows)
    text = {i: x for i, x, _ in rows}
    for i, name, score, rejected in got:
        x = text[i]
        if x is None or not any(c.isalpha() for c in x):
            assert (name, score, rejected) == ("und", 0.0, True)
            continue
        v = vector(x)
        scores = [dot(v, c) for _, c, _ in centroids]
        top = max(scores)
        assert abs(score - top) < 1e-4
        assert name in {n for (n, _, _), s in zip(centroids, scores, strict=True) if s > top - 1e-4}
        least = centroids[max(range(len(scores)), key=scores.__getitem__)][2]
        assert rejected == (top < least) or abs(top - least) < 1e-4
    assert {name for i, name, *_ in got if i >= 10_000} == {"aa"}


def test_language_sample_is_bounded(spark, monkeypatch):
    """A language, and a text, that hold most rows: the sample has each text once, and at most its share of them."""
    monkeypatch.setattr(langid, "SAMPLE", 100)
    rows = [("en", b"same")] * 500 + [("en", b"en %d" % k) for k in range(2000)] + [("de", b"de %d" % k) for k in range(30)]
    t = spark.createDataFrame(rows, "lang string, t binary").withColumn("h", F.xxhash64("t"))
    got = local(langid.sampled(t, 2), "lang", "h", "t")
    hashes = sorted({h for name, h in local(t, "lang", "h") if name == "en"})
    assert sorted(h for name, h, _ in got if name == "en") == hashes[:50]
    assert sum(name == "de" for name, *_ in got) == 30


def brute_lines(rows):
    """Lines that go, as (id, text, place), and the least Jaccard similarity by which any goes."""
    def cut(x):
        b = x.encode()
        return {b[i : i + linededup.WIDTH] for i in range(max(1, len(b) - linededup.WIDTH + 1))}

    places = {}
    for i, text in rows:
        for n, x in enumerate((text or "").split("\n")):
            if space_words(x):
                places.setdefault(x, []).append((i is None, i or 0, text, n))
    sets = {x: cut(x) for x in places}
    root = classes_of(sorted(places), lambda a, b: len(sets[a] & sets[b]) >= similar.SIMILARITY * len(sets[a] | sets[b]))
    return places, root


def test_line_dedup(spark, docs):
    rng = random.Random(6)
    base = [prose(rng, n) for n in (4, 12, 40, 90, 200)]
    # four copies of each line, all different, one character or word apart, beside fresh lines
    rows = [(k, "\n".join([prose(rng, 30), *(b.replace("the", "t" + "xyzw"[k % 4], 1) if len(b) > 400 else b for b in base), "", "  "])) for k in range(8)]
    rows += [(20, None), (21, ""), (22, "short"), (23, "short"), (24, "shore"), (None, base[4]), (25, base[4] + "\n" + prose(rng, 20) + "\n" + base[4]), rows[1], (1, base[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("l", F.lit("l"))
    places, root = brute_lines(rows)
    hashed = {r.text: r.x for r in df.select("text", F.xxhash64("text").alias("x")).distinct().collect()}
    first, want = {}, set()
    order = lambda p: (p[0], p[1], hashed[p[2]], p[3])
    for x, at in places.items():
        best = min(at, key=order)
        first[root[x]] = min(first.get(root[x], best), best, key=order)
    for x, at in places.items():
        want |= {order(p) for p in at if order(p) != order(first[root[x]])}
    got = {(k.last, k.id or 0, k.x, n) for k, n in local(linededup.duplicates(df), "k", "n")}
    assert got == want
    kept = linededup.deduplicated(df)
    assert kept.columns == df.columns
    left = [x for r in kept.collect() for x in (r.text or "").split("\n") if space_words(x)]
    assert len({root[x] for x in left}) == len(set(root.values())) and len(left) == len(set(root.values())) + sum(1 for x in rows[1][1].split("\n") if space_words(x) and order((False, 1, rows[1][1], rows[1][1].split("\n").index(x))) not in want)
    assert kept.where("doc_id in (20, 21)").count() == 2 and kept.where("doc_id = 23").count() == 0
    assert linededup.duplicates(df.limit(0)).count() == 0


def cut_line(x):
    b = x.encode()
    return {b[i : i + linededup.WIDTH] for i in range(max(1, len(b) - linededup.WIDTH + 1))}


def similar_lines(u, v):
    return len(u & v) >= similar.SIMILARITY * len(u | v)


def test_line_dedup_compares_whole_buckets(spark, monkeypatch):
    """Buckets of many families: the components are those of all similar pairs that share a bucket."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    base = letters(96)
    texts = [base + x + end for x in [letters(14) for _ in range(90)] for end in ("", "q", "z")]
    lines = written(linededup._lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"))
    sets = {h: cut_line(x) for h, x in local(lines, "h1", "l")}
    buckets = {}
    for h, keys in local(linededup._banded(lines), "h1", "keys"):
        for b in keys:
            buckets.setdefault(b, set()).add(h)
    met = {(u, v) for hs in buckets.values() for u in hs for v in hs if u < v}
    near = {(u, v) for u, v in met if similar_lines(sets[u], sets[v])}
    want = classes_of(sorted(sets), lambda u, v: (u, v) in near or (v, u) in near)
    assert len(met) > 5 * len(near)
    for chunk in (1024, 7):
        monkeypatch.setattr(similar, "CHUNK", chunk)
        got = dict(local(linededup.components(lines), "h1", "root"))
        assert {h: got.get(h, h) for h in want} == want


@pytest.mark.parametrize(("shared", "own"), [(150, 55), (280, 66), (60, 24)])
def test_line_dedup_recall_on_boilerplate(spark, shared, own):
    """Pairs that differ in their last letter, all sharing much boilerplate: merges against comparing all pairs."""
    import numpy as np

    rng = random.Random(shared)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    base = letters(shared)
    texts = [base + x + end for x in [letters(own) for _ in range(1000)] for end in "qz"]
    lines = written(linededup._lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"))
    names, found = zip(*local(lines, "h1", "l"), strict=True)
    place = {g: k for k, g in enumerate({g for x in found for g in cut_line(x)})}
    matrix = np.zeros((len(found), len(place)), np.float32)
    for k, x in enumerate(found):
        matrix[k, [place[g] for g in cut_line(x)]] = 1
    both = matrix @ matrix.T
    sizes = matrix.sum(axis=1)
    near = both >= similar.SIMILARITY * (sizes[:, None] + sizes - both)
    want = classes_of(range(len(names)), lambda u, v: near[u, v])
    got = dict(local(linededup.components(lines), "h1", "root"))
    merges = len(names) - len(set(want.values()))
    made = len(names) - len({got.get(h, h) for h in names})
    assert 0.95 * merges <= made <= merges


def test_line_dedup_copies_of_one_line(spark, monkeypatch):
    """A line that holds most rows, and a component that holds most lines, go through the joins for hot keys alike."""
    from corvane.llm import common

    rng = random.Random(3)
    base = prose(rng, 60)
    rows = [(k, f"a line that all have, and all keep once\n{base} {'abcdefgh'[k % 8]}\n{prose(rng, 25)}") for k in range(60)] + [(60 + k, prose(rng, 30)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(k, 0) for k in range(1, 60)} | {(k, 1) for k in range(1, 60)}
    for hot in (1000, 1):
        monkeypatch.setattr(common, "HOT", hot)
        assert set(local(linededup.duplicates(df), "k.id", "n")) == want


def test_line_dedup_long_line(spark):
    long = prose(random.Random(1), 60_000)
    rows = [(0, long), (1, long + " x\nshort"), (2, "y " + long), (3, "\n".join(["same"] * 50_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(local(linededup.deduplicated(df), "doc_id", "text"))
    assert kept == {0: long, 1: "short", 3: "same"}


def test_line_dedup_signatures(monkeypatch):
    """Equal sets of shingles have equal signatures, whatever the pieces; places agree as often as lines are similar."""
    rng = random.Random(12)
    texts = [prose(rng, n).encode() for n in (3, 5, 18, 40, 400)] + [b"=" * 12, b"=" * 500, b"=" * 30, b"-+" * 90]
    whole = linededup.signatures(texts)
    assert (whole[5] == whole[6]).all() and (whole[5] == whole[7]).all() and not (whole[5] == whole[8]).any()
    monkeypatch.setattr(linededup, "PIECE", 17)
    assert (linededup.signatures(texts) == whole).all()
    monkeypatch.undo()
    agree = want = 0.0
    for _ in range(400):
        a = prose(rng, 40)
        b = a[: len(a) - rng.randint(1, 60)] + prose(rng, 4)
        x, y = linededup.signatures([a.encode(), b.encode()])
        agree += (x == y).mean()
        want += len(cut_line(a) & cut_line(b)) / len(cut_line(a) | cut_line(b))
    assert abs(agree - want) < 0.02 * 400


def test_license_long_templates_and_common_texts(spark, monkeypatch):
    """A whole license with words put in and left out is found; a text that most rows have is joined either way."""
    from corvane.llm import common

    whole = max((t for t in license.TEMPLATES if t.label == "mit"), key=lambda t: len(t.words)).words.split()
    changed = " ".join(w for k, w in enumerate(whole) if k % 40) .replace("as is", "as is and as available")
    rows = [(k, "Copyright someone. " + changed) for k in range(40)] + [(40 + k, f"plain text {k}") for k in range(10)] + [(50, None), (51, "x " * 200_000 + " ".join(whole))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1000, 1):
        monkeypatch.setattr(common, "HOT", hot)
        got = {r[0]: r[1:] for r in local(license.scan(df), "row.doc_id", "labels", "score", "n_words")}
        assert len(got) == len(rows) and got[51] == ("mit", 1.0, 200_000 + len(whole)) and got[50] == ("", 0.0, 0)
        assert all(got[k][0] == "mit" and 0.7 < got[k][1] <= 1 for k in range(40)) and not any(got[k][0] for k in range(40, 50))


def test_license_copies_back_to_back(spark):
    notice = "All rights reserved."
    texts = [notice, f"{notice} {notice}", f"{notice} {notice} {notice}", "all rights x y z w rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r[0]: r[1:] for r in local(license.scan(df), "row.doc_id", "labels", "score", "spans")}
    for k in range(3):
        assert by[k][:2] == ("all-rights-reserved", 1.0)
        assert [(x.start, x.words, x.score) for x in by[k][2]] == [(by[0][2][0].start + 3 * i, 3, 1.0) for i in range(k + 1)]
    assert by[3][0] == ""


def test_line_dedup_runs_no_python(spark, monkeypatch):
    """Line dedup is DataFrame functions only, with small buckets, large ones and chunks of them, whoever finds the links."""
    rng = random.Random(8)
    base = prose(rng, 60)
    rows = [(k, f"{base} {chr(97 + k % 26)}{chr(97 + k // 26)}\n{prose(rng, 25)}") for k in range(40)]
    pair = prose(rng, 50)
    rows += [(40, pair + " x"), (41, pair + " y"), (42, prose(rng, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(df), name, lambda *a, **k: pytest.fail("Python on the executors"))
    want = {(k, 0, 0) for k in range(1, 40)} | {(41, 0, 40)}
    for name, value in (("CHUNK", 1024), ("CHUNK", 7), ("MANY", 10**6)):
        monkeypatch.setattr(similar if name == "CHUNK" else linededup, name, value)
        got = linededup.duplicates(df)
        assert set(local(got, "k.id", "n", "keeper.k.id")) == want
        assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_line_dedup_minima(spark, monkeypatch):
    """The signatures that Spark takes are those of the model; in large lines, which leave hashes out, nearly all places are."""
    rng = random.Random(13)
    texts = [prose(rng, n) for n in (2, 3, 5, 18, 30)] + ["=" * 12, "=" * 500, "é" * 20] + [prose(rng, rng.randint(60, 200)) for _ in range(60)]
    lines = written(linededup._lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"))
    names = {h: x.encode() for h, x in local(lines, "h1", "l") if len(x.encode()) >= linededup.WIDTH}
    whole = dict(zip(names, linededup.signatures(list(names.values())).astype("int64").tolist(), strict=True))

    def made():
        return {r[0]: [x + 2**31 for x in r[2:]] for r in linededup._minima(lines).collect()}

    part = made()
    assert part.keys() == whole.keys() and all(part[h] == whole[h] for h, x in names.items() if len(x) < linededup.LARGE)
    large = [a == b for h, x in names.items() if len(x) >= linededup.LARGE for a, b in zip(part[h], whole[h], strict=True)]
    assert len(large) > 900 and sum(large) > 0.98 * len(large)
    monkeypatch.setattr(linededup, "LARGE", 1 << 30)
    for piece in (1 << 16, 17):
        monkeypatch.setattr(linededup, "PIECE", piece)
        assert made() == whole


def test_line_dedup_compares_each_pair_once(spark, monkeypatch):
    """Lines that share several buckets are compared in one of them, whatever the chunks and whoever is connected already."""
    buckets = {10: [1, 2, 3, 4], 20: [2, 3, 4, 5], 30: [3, 4, 6], 40: [1, 2, 3, 4, 5, 6, 7]}
    texts = [(h, [b for b, hs in buckets.items() if h in hs], 1, [h], [0] * 16) for h in range(1, 8)]
    texts = spark.createDataFrame(texts, "h1 long, buckets array<long>, size int, s array<int>, x array<long>")
    monkeypatch.setattr(linededup, "_alike", lambda: "true")
    monkeypatch.setattr(type(texts), "distinct", lambda df: df)
    for chunks in (1, 3):
        members = spark.createDataFrame([(b, h, chunks, h % chunks) for b, hs in buckets.items() for h in hs], "bucket long, h1 long, chunks long, p long")
        for root in ({}, {1: 1, 2: 1}, {3: 3, 4: 3, 6: 3, 5: 5, 7: 5}, dict.fromkeys(range(1, 8), 1)):
            roots = spark.createDataFrame(list(root.items()), "node long, root long")
            got = [(min(u, v), max(u, v)) for u, v in local(linededup._apart(members, roots, texts), "u", "v")]
            assert sorted(got) == [(u, v) for u in range(1, 8) for v in range(u + 1, 8) if root.get(u, u) != root.get(v, -v)]


def test_line_dedup_sketches_lose_no_similar_pair(spark):
    """Sketches tell most pairs apart that are not similar, and none that are, those at the very limit included."""
    rng = random.Random(14)
    hashes = lambda n: [rng.randint(-2**31, 2**31 - 1) for _ in range(n)]
    pairs = [(x := hashes(1), x), (hashes(1), hashes(1)), (x := hashes(9), x[1:])]
    for n in (9, 90, 450, 2700):  # of n + m hashes, n in both: similar from n = 4 m
        for m in (n // 9, n // 4, n // 4 + 1, n // 3, n // 2, n):
            for own in (0, m // 2):
                both, rest = hashes(n), hashes(m)
                pairs.append((both + rest[:own], rest[own:] + both))
    sets = [x for pair in pairs for x in pair]
    t = spark.createDataFrame([(k, len(x), x) for k, x in enumerate(sets)], "h1 long, size int, s array<int>")
    t = t.join(linededup._sketched(t), "h1")
    found = dict(local(t, "h1", "x"))
    for k, x in enumerate(sets):
        want = [0] * linededup.WORDS
        for h in x:
            want[(h >> 6) % linededup.WORDS] ^= 1 << h % 64
        assert [w % 2**64 for w in found[k]] == want
    u, v = (t.where(f"h1 % 2 = {k}").select(*[F.col(c).alias(f"{side}_{c}") for c in t.columns]) for k, side in enumerate("uv"))
    got = {h // 2 for h, in local(u.join(v, F.expr("u_h1 + 1 = v_h1")).where(linededup._alike()), "u_h1")}
    assert got == {k for k, (x, y) in enumerate(pairs) if similar_lines(set(x), set(y))} and 10 < len(got) < len(pairs) / 2
    far = [k for k, (x, y) in enumerate(pairs) if 90 < len(x) < 1000 and len(set(x) & set(y)) < 0.76 * len(set(x) | set(y))]
    odd = [sum((a ^ b).bit_count() for a, b in zip(found[2 * k], found[2 * k + 1], strict=True)) for k in far]
    apart = [9 * n > len(pairs[k][0]) + len(pairs[k][1]) for n, k in zip(odd, far, strict=True)]
    assert len(far) == 9 and all(apart)
