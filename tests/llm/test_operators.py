"""Every operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import common, decontaminate, langid, licenses, media, neardup, packing, quality, substrings, urlfilter, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = [f"{a}{b}" for a in ("ta", "re", "mi", "so", "ul", "ka") for b in ("n", "lo", "vet", "s", "mar", "", "pi")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = prose(rng, 60)
    base = prose(rng, 120)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(30)]
    near = base.split()
    for i in range(8):
        words = near.copy()
        for _ in range(i):
            words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
        texts.append(" ".join(words))
    texts += [base, base, "", None, "   \n\t ", "one", "One", "one two", "123 456 !!", "Ünïcode\u00a0Straße ΣΑΣ <|endoftext|> it's 1st", passage, f"{prose(rng, 30)} {passage} {prose(rng, 10)}", f"{passage} {passage}", prose(rng, 9000)]
    texts += ["Licensed under CC BY-NC 4.0.\nAll rights reserved.", "GNU General  Public-License, version 3; general public license. Apache License, Version 2.0", "cc BY cc by CC-BY"]
    out = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[-1], out[3], (None, "nobody's text here", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = {"score": F.lit(1), "labels": F.lit("x"), "row": F.lit(2), "at": F.lit(3), "reference": F.lit(4), "hashes": F.lit("h"), "id": F.lit(9), "component": F.lit(1), "piece": F.lit(7), "task": F.lit(7), "length": F.lit(5), "media": F.lit("m"), "held_out": F.lit(0)}
    return spark.createDataFrame(rows, DOCS).withColumns(clash).repartition(5)


def none(docs):
    return docs.limit(0)


def test_rolled_hashes_tell_sequences_apart():
    h = common.word_hashes(b"a b c d e f g a b c d e")
    for n in (1, 2, 3, 5, 6, 11):
        r = common.rolled(h, n)
        assert len(r) == 13 - n
        seen = defaultdict(set)
        for i, x in enumerate(r):
            seen[tuple(h[i : i + n])].add(int(x))
        assert all(len(s) == 1 for s in seen.values()) and len({next(iter(s)) for s in seen.values()}) == len(seen)
    assert len(common.word_hashes(b" \n\t ")) == 0
    assert len(set(common.word_hashes(b"x" * 5000 + b" " + b"x" * 5001 + b" x").tolist())) == 3


@pytest.mark.parametrize("odd", ["x" * 5000, "y" + " " * 5000], ids=["long word", "blanks"])
def test_a_long_word_or_blanks_leave_the_other_words_hashes(spark, odd):
    rng = random.Random(6)
    words = [f"u{rng.randrange(10**6)}" for _ in range(100)]
    assert common.word_hashes(f"{odd} a b".encode())[1:].tolist() == common.word_hashes(b"a b").tolist()
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], odd, *words[50:]]))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.components(table, 5).collect()} == {1: 1, 2: 1}
    got = sorted(tuple(r) for r in substrings.digest(table).collect())
    assert got == sorted(brute_kept(rows)) and [r[2] for r in got] == [0, 100]


def test_op1_base_places_and_method(docs, rows):
    got = sorted(map(tuple, licenses.scan(docs).collect()), key=str)
    want = []
    for doc, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        want.append((doc, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert [r[:6] for r in got] == sorted(want, key=str)
    labels = {r[0]: r[6] for r in got}
    named = {r[1]: labels[r[0]] for r in rows if r[1]}
    assert "cc-by-nc-4.0" in named["Licensed under CC BY-NC 4.0.\nAll rights reserved."] and "reserved" in named["Licensed under CC BY-NC 4.0.\nAll rights reserved."]
    assert len(licenses.RULES) > 200 and all(set(filter(None, r[5].split(","))) <= set(filter(None, r[6].split(","))) and 0 <= r[7] <= 1 for r in got)
    assert licenses.scan(none(docs)).count() == 0


def brute_detections(joined):
    """All rules over the whole text, best first; one inside an accepted one goes."""
    found = [(r, m.start(), m.end()) for r in licenses.RULES for m in r.pattern.finditer(joined) if r.keyword in joined]
    kept = []
    for r, a, b in sorted(found, key=lambda d: (-d[0].priority, d[1] - d[2], d[1], d[0].order)):
        if not any(x <= a and b <= y for _, x, y in kept):
            kept.append((r, a, b))
    return kept


def test_op1_suppression_by_brute_force():
    texts = [b"GNU Lesser General Public License, version 2.1", b"SPDX-License-Identifier: Apache-2.0", b"the MIT license, the MIT License and the mit license", b"GNU GPL version 2 or GPL; LGPL v2.1. All rights reserved, some rights reserved", b"cc by-nc-sa 4.0 cc by cc by-nd", b"", b"none here", b"Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT License. " * 3]
    for t in texts:
        joined = licenses.words_of(t)
        assert licenses.detect(joined) == brute_detections(joined)
    spans = lambda t: [x[0] for x in licenses.spans_of(t)]
    # the short mention and the plain GPL name lie inside, and go
    assert spans(b"GNU Lesser General Public License, version 2.1") == ["lgpl-2.1"] and spans(b"SPDX-License-Identifier: Apache-2.0") == ["apache-2.0"]
    # equal detections are both kept, in their places
    assert spans(b"x11 license, x11 license") == ["x11", "x11"]
    # the better one first: an identifier inside a longer mention is no part of it
    assert [r.priority for r, _, _ in licenses.detect(licenses.words_of(b"apache license; spdx license identifier mit"))] == [3, 1]


def test_op1_patterns_are_hundreds_without_their_versions():
    assert len({re.sub(rb"\\d|[0-9]+", b"", r.pattern.pattern) for r in licenses.RULES}) > 250


def test_op2_rules_by_brute_force(spark):
    urls = ["http://www.example.com/en/1", "https://a.EXAMPLE.com/en/", "http://example.com/enx", "http://x.com", "http://x.com/?q", "http://notexample.com/en/1", "ftp://b.net/es/1?x=/fr/", "http://b.net/fr/", "http://net/es/", "http://b.org/en/1#a", "nothing", "", None, "http://x.net?/es/", "http://www.example.com/de/", "a://b://c.com/", "HTTP://m.WWW.example.com/en/x"] * 2
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id bigint, url string, html string").withColumn("rule", F.lit(1)).withColumn("u", F.lit(2))
    got = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_op2_trees_tell_hosts_they_do_not_know(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    urls = [f"http://{word()}.{word()}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['es', 'fr', 'en', 'de'])}/{word()}/{rng.randrange(1000)}{rng.choice(['', '?a=1', '#x'])}" for _ in range(900)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumns({c: F.lit("z") for c in ("host", "path", "verdict", "given", "p_block", "fold ", "bucket")})
    held = urlfilter.held_out(pages).collect()
    assert len(held) > 50 and {r["given"] for r in held} == {"allow", "block"}
    assert np.mean([(r["p_block"] >= 0.5) == (r["given"] == "block") for r in held]) > 0.9
    got = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    assert len(got) == len(urls) and len({r["p_block"] for r in got.values() if r["rule"] is None}) > 10
    # shares out of fold by brute force
    rows = urlfilter.with_features(pages).where("given is not null")
    table = urlfilter.with_statistics(rows, urlfilter.suffix_counts(rows), out_of_fold=True).withColumn("fold", urlfilter._fold()).collect()
    for r in table[:40]:
        others = [x["given"] == "block" for x in table if x["last_label"] == r["last_label"] and x["fold"] != r["fold"]]
        assert abs(r["p_last_label"] - (sum(others) + 1) / (len(others) + 2)) < 1e-9


def test_op3_round_trip(docs, rows):
    got = defaultdict(list)
    for r in media.round_trip(docs).collect():
        got[r["doc_id"]].append(r)
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        for r in got[doc]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            box = media.write_container(raw)
            assert (r["media_bytes"], r["media_sha256"]) == (len(box), hashlib.sha256(box).hexdigest())
            assert len(r["keyframe_start"]) == -(-len(payload) // (64 * media.SYNC)) and all(box[a : a + n] == payload[k * 4096 : k * 4096 + 64] for k, (a, n) in enumerate(zip(r["keyframe_start"], r["keyframe_bytes"], strict=True)))
    assert sum(map(len, got.values())) == len(rows)
    with pytest.raises(ValueError):
        list(media.walk(b"\0\0\0\xffmoov"))


def test_op4_accuracy_und_and_filter(spark, docs):
    rng = random.Random(3)
    kinds = {"aa": "abcdef", "bb": "uvwxyz"}
    data = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(20)), k) for i in range(90) for k in [rng.choice(["aa", "bb"])]]
    data += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None)]
    table = spark.createDataFrame(data, "doc_id bigint, text string, lang string").withColumn("lang_pred", F.lit("zz"))
    got = {r["doc_id"]: r for r in langid.identify(table).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in data if i < 1000)
    assert all(got[i]["lang_pred"] == "und" for i in (1000, 1001, 1002))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    kept = langid.accepted(table)
    assert kept.columns == table.columns and kept.count() == 90
    assert langid.identify(none(docs)).count() == 0 and langid.accepted(none(docs)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
    # nothing is known of any language: all documents with a letter stay
    assert langid.accepted(unlabelled).count() == sum(any(map(str.isalpha, r["text"] or "")) for r in docs.select("text").collect())


def brute_languages(rows, texts):
    """Multinomial naive Bayes in dictionaries, n-gram by n-gram, with the operator's hash of one n-gram."""
    of = lambda text: [bucket_of(text[i : i + n]) for n in langid.ORDERS for i in range(len(text) - n + 1)]

    def bucket_of(gram):
        h = np.array([len(gram)], np.uint32)
        for c in gram:
            h = (h ^ np.uint32(ord(c))) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return int(h[0] >> np.uint32(32 - langid.BITS))

    counts, documents = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for text, lang in rows:
        documents[lang] += 1
        for b in of(text.lower()):
            counts[lang][b] += 1
    out = []
    for text in texts:
        total = {}
        for lang in sorted(documents):
            size = sum(counts[lang].values()) + langid.ALPHA * 2**langid.BITS
            total[lang] = np.log((documents[lang] + 1) / sum(n + 1 for n in documents.values())) + sum(np.log((counts[lang].get(b, 0) + langid.ALPHA) / size) for b in of(text.lower()))
        best = max(total, key=total.get)
        out.append((best, 1 / sum(np.exp(v - total[best]) for v in total.values())))
    return out


@pytest.mark.parametrize("block, piece", [(langid.BLOCK, langid.PIECE), (2, 50)], ids=["one matrix", "blocks and pieces"])
def test_op4_equals_naive_bayes_by_brute_force(spark, monkeypatch, block, piece):
    rng = random.Random(14)
    data = [(i, " ".join("".join(rng.choice("abcdeéß" if k < "c" else "defgh") for _ in range(4)) for _ in range(rng.randint(1, 25))), k) for i in range(60) for k in [rng.choice("abcde")]]
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "PIECE", piece)
    want = brute_languages([(t, k) for _, t, k in data], [t for _, t, _ in data])
    # counts and scores in one process: the workers would not see the patched sizes
    from pyspark.sql import DataFrame

    def here(df: DataFrame, schema, make, binary=(), finish=False):
        work, out = make(), []
        columns = {c: [r[c] for r in df.collect()] for c in df.columns}
        for made in (work(columns), work(None) if finish else None):
            if made:
                out += list(zip(*[np.asarray(made[c.split()[0].strip("`")], object).tolist() if "`" not in c else list(made[c.split("`")[1]]) for c in schema.split(", ")], strict=True))
        plain = lambda v: v.item() if isinstance(v, np.generic) else v
        return spark.createDataFrame([tuple(map(plain, r)) for r in out], schema)

    monkeypatch.setattr(langid, "map_rows", here)
    table = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    models = langid.train(table)
    assert len(models) == -(-5 // block)
    got = {r["doc_id"]: r for r in langid.predict(table, models, ["doc_id"]).collect()}
    for (i, _, _), (best, score) in zip(data, want, strict=True):
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - score) < 1e-4


def test_op5_packs_every_token(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    got = packing.pack(docs).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    want = sorted((-1 if doc is None else doc, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for doc, t, *_ in rows for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids + [0]] for i in range(0, len(ids), 2048))
    assert sorted(map(tuple, got.assign(doc_id=got.doc_id.fillna(-1).astype("int64"))[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == want
    assert packing.pack(none(docs)).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    return len(gaps)


def placed_alone(runs, lengths, capacity):
    """Every piece once, sequences not overfull, places gapless from 0; the number of sequences."""
    taken, held = defaultdict(list), defaultdict(list)
    for r in runs:
        for k in range(r["n"]):
            taken[r["size"]].append(r["first"] + k)
            held[r["sequence"] + k // r["each"]].append((r["offset"] + k % r["each"] * r["size"], r["size"]))
    assert all(sorted(taken[n]) == list(range(lengths.count(n))) for n in set(lengths)) and sum(map(len, taken.values())) == len(lengths)
    for here in held.values():
        end = 0
        for offset, size in sorted(here):
            assert offset == end
            end += size
        assert end <= capacity
    return len(held)


@pytest.mark.parametrize("capacity, draw", [(97, lambda r: r.randint(1, 97)), (50, lambda r: r.choice([1, 2, 3, 50])), (2048, lambda r: 1 + int(r.expovariate(1 / 400)) % 2048), (10, lambda r: 4)], ids=["even", "ties", "skewed", "one length"])
def test_op5_rounds_use_as_few_sequences_as_best_fit_decreasing(spark, capacity, draw):
    rng = random.Random(1)
    lengths = [draw(rng) for _ in range(400)]
    classes = spark.createDataFrame([(n, lengths.count(n)) for n in set(lengths)], "size int, n bigint")
    least = max(-(-sum(lengths) // capacity), sum(n > capacity // 2 for n in lengths))
    assert least <= placed_alone(packing.place(classes, capacity).collect(), lengths, capacity) <= best_fit_decreasing(lengths, capacity) + 1


def test_op5_a_sweep_gives_each_gap_the_largest_pieces_that_fit():
    out = packing.sweep([(0, 3, 0, 5), (1, 7, 0, 2), (0, 6, 0, 1), (1, 2, 5, 1), (1, 3, 9, 1)], 10)
    assert sorted(out) == sorted([(1, 2, 5, 1, 0, 0, 0), (3, 3, 0, 1, 1, 9, 7), (3, 6, 0, 1, 1, 0, 3), (2, 1, 0, 1, 0, 0, 0), (3, 3, 1, 2, 2, 1, 3), (2, 1, 1, 1, 0, 0, 0), (0, 3, 3, 2, 0, 0, 0)])


def test_op5_other_vocabularies_give_their_own_ids(tmp_path):
    import json

    from tokenizers import Tokenizer

    assert packing.Tokens(packing.vocabulary()).by_chunks
    with open(packing.vocabulary()) as f:
        changed = json.load(f)
    changed["normalizer"] = None
    other = tmp_path / "other.json"
    other.write_text(json.dumps(changed))
    tokens, text = packing.Tokens(str(other)), "Some WORDS and 42 Numbers"
    assert tokens.of(text.encode()).tolist() == [*Tokenizer.from_file(str(other)).encode(text, add_special_tokens=False).ids, 0]


def test_op6_learns_and_calibrates(spark, docs):
    rng = random.Random(8)
    data = []
    for i in range(300):
        good = rng.random() < 0.7
        data.append((i, prose(rng, 40) if good else " ".join(w.upper() + "!!" for w in prose(rng, 40).split()), int(good)))
    table = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, "")], "doc_id bigint, text string").withColumn("quality", F.lit(0))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data] + [(900, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(table, labels).collect()}
    assert len(got) == 302 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and np.mean([got[i]["predicted"] == data[i][2] for i in held]) > 0.95
    assert {r["score"] for r in quality.classify(table, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(none(docs), labels).count() == 0


def test_op6_score_by_brute_force():
    """Vectors, pooling and network again, word by word in plain Python."""
    rng = np.random.default_rng(3)
    texts = [b"Some WORDS here, some words there", b"", None, b"one\none\nTWO!! 12"]
    for t in texts:
        rows, shapes = quality.places(t)
        assert len(rows) == len(shapes) == len((t or b"").split())
    vectors = rng.normal(size=(quality.BUCKETS + quality.SHAPES, quality.DIMENSIONS)).astype(np.float32)
    for t in texts:
        got, want = quality.pool(t, vectors), []
        for rows in quality.places(t):
            v = [vectors[r].astype(float) for r in rows]
            mean = [sum(x[i] for x in v) / len(v) if v else 0.0 for i in range(quality.DIMENSIONS)]
            want += mean + [max(0.0, sum(x[i] ** 2 for x in v) / len(v) - mean[i] ** 2) ** 0.5 if v else 0.0 for i in range(quality.DIMENSIONS)]
        words, lines = quality.places(t)[0], (t or b"").split(b"\n")
        want += [len(set(words.tolist())) / max(1, len(words)), len(set(lines)) / len(lines), np.log1p(len(words)) / 10]
        assert np.allclose(got, want, atol=1e-4)
    x, y = rng.normal(size=(200, 5)), (np.arange(200) % 2).astype(float)
    x[:, 0] += 2 * y
    net = quality.Network(x, y)
    for row, score in zip(x[:20], net.score(x[:20]), strict=True):
        z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(row, net.centre, net.spread, strict=True)]
        h = [np.tanh(sum(a * net.p[0][i][k] for i, a in enumerate(z)) + net.p[1][k]) for k in range(quality.HIDDEN)]
        logit = sum(a * b for a, b in zip(h, net.p[2], strict=True)) + net.p[3][0]
        assert abs(score - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-9
    assert 0.25 <= net.temperature <= 8 and np.mean((net.score(x) >= 0.5) == y) > 0.8


def brute_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_op7_finds_every_item_at_the_threshold(spark, rows):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(5, 60))) for i in range(12)] + [(50, "tiny item"), (54, "one"), (55, "a rather short item"), (51, ""), (52, None), (None, prose(rng, 12)), (53, "  ...  ")]
    data = list(rows)
    for i, (_, t) in enumerate(items):
        if t and t.strip(". "):
            w = t.split()
            cut = w[: max(1, len(w) - i % 5 * len(w) // 12)]
            data.append((2000 + i, f"{prose(rng, 80)} {' '.join(cut).upper()} {prose(rng, 200)}", "en", "s", 1))
    table = spark.createDataFrame(data, DOCS).withColumn("hashes", F.lit(1)).withColumn("shingle", F.lit(2)).withColumn("words", F.lit(2))
    bench = spark.createDataFrame([*items, items[0]], "item_id bigint, text string").withColumn("n", F.lit(1))
    want = []
    for doc, t, *_ in data:
        w = brute_words(t)
        s = {tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1)}
        for item, q in items:
            need = brute_shingles(brute_words(q), 5)
            if need and len(need & s) >= -(-len(need) * 8 // 10):
                want.append((doc, item, len(need), len(need & s)))
    got = [tuple(r)[:4] for r in decontaminate.found(table, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) >= 8 and (2012, 50, 1, 1) in want  # two words in a long document
    kept = decontaminate.clean(table, bench)
    bad = {w[0] for w in want}
    assert kept.columns == table.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in data if r[0] not in bad), key=str)
    signed = [r.asDict() for r in decontaminate.signatures(bench).collect()]
    for item, q in dict(items).items():
        n = len(brute_shingles(brute_words(q), 5))
        mine = [r for r in signed if r["item_id"] == item]
        assert {(r["partition"], r["least"]) for r in mine} == ({(max(n - 1, 0).bit_length(), len(mine) - n // 5)} if n else set()) and len(mine) <= n
    assert decontaminate.found(none(table), bench).count() == 0 and decontaminate.clean(table, bench.limit(0)).count() == len(data)


def test_op7_rows_of_one_item_id_are_one_item(spark):
    rng = random.Random(15)
    a, b = prose(rng, 12), prose(rng, 14)
    bench = spark.createDataFrame([(1, a), (1, b), (2, a), (2, a)], "item_id bigint, text string")
    table = spark.createDataFrame([(10, f"{a} and {b}"), (11, a), (12, f"{a} . {b}"), (12, f"{a} . {b}")], "doc_id bigint, text string")
    got = sorted(tuple(r)[:4] for r in decontaminate.found(table, bench).collect())
    assert got == sorted([(10, 1, 18, 18), (10, 2, 8, 8), (11, 2, 8, 8), *[(12, 1, 18, 18), (12, 2, 8, 8)] * 2])


def brute_components(rows, k):
    sets = {}
    for doc, t, *_ in rows:
        w = (t or "").encode().lower().split()
        if doc is not None:
            sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sets, {d: root(d) for d in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_op8_components(docs, rows, k):
    sets, want = brute_components(rows, k)
    got = neardup.components(docs, k).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    kept = neardup.representatives(docs, k)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert neardup.components(none(docs), k).count() == 0 and neardup.representatives(none(docs), k).count() == 0


def test_op8_rows_of_one_id_and_repeats_in_the_filter(spark):
    rng = random.Random(16)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "z"), (2, f"{c} end", "x"), (3, c, "x"), (None, b, "x"), (None, b, "w"), (4, None, "x"), (4, None, "x"), (5, "", "x")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, id string")
    for parts in (1, 7):
        got = [tuple(r) for r in neardup.representatives(table.repartition(parts)).collect()]
        assert sorted((r[:2] for r in got), key=str) == sorted([(1, a), (1, b), (2, f"{c} end"), (None, b), (4, None), (5, "")], key=str)
        seen = seen if parts > 1 else sorted(got, key=str)
        assert sorted(got, key=str) == seen


def test_op8_chain_far_from_the_centre(spark):
    """Mutants of one text that are near one another, but not near the most connected one, still count."""
    rng = random.Random(9)
    base = [f"u{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        words = base.copy()
        for _ in range(rng.randint(0, 24)):
            words[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        if i % 6 == 0:
            words[5] = "again"
            rows.append((100 + i, " ".join(words)))
    sets, want = brute_components(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}
    assert got == want and 1 < len(set(want.values())) < len(rows)


def test_op8_near_copies_that_their_centre_rejects(spark, monkeypatch):
    """All documents in one bucket, whose centre is like none of them; blocks of a few rows, so that pairs lie across blocks."""
    rng = random.Random(10)
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(100))) for i in range(20)]
    rows += [(i + 20, f"{t} tail") for i, t in rows[:8]] + [(99, " ".join(f"u{rng.randrange(10**6)}" for _ in range(100)))]
    sketch = neardup.sketch
    one = lambda *a: sketch(*a).withColumn("bands", F.array(F.lit(1).cast("bigint")))
    monkeypatch.setattr(neardup, "sketch", one)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}
    assert got == {i: i - 20 if 20 <= i < 28 else i for i, _ in rows}


def test_op8_odd_sketch_estimates():
    rng = np.random.default_rng(2)
    for share in (0.6, 0.8, 0.95):
        errors = []
        for _ in range(20):
            both, rest = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64), int(1000 * (1 - share) / 2)
            a, b = (np.unique(np.r_[both, rng.integers(0, 2**63, rest, dtype=np.uint64)]) for _ in range(2))
            x, y = (neardup.odd_sketch(neardup.samples(s)) for s in (a, b))
            errors.append(neardup.estimate(np.bitwise_count(x ^ y).sum()) - share)
        assert abs(np.mean(errors)) < 0.04 and np.abs(errors).max() < 0.2


def test_op9_round_trip_and_lookup(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", "", None, "é" * 3000, "<p>a</p>", "x" * 3_000_000]
    rows = [(7 - i, f"http://www.Host{i % 3}.org/p/{i}?q", h) for i, h in enumerate(html)] + [(50, None, "<p>c</p>"), (51, "no scheme", "<p>c</p>"), (52, "http://h.org/x\ty z\r\n", ""), (53, "http://h.org/x\ty z\r\n", "")]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("key", F.lit("k"))
    got = sorted(tuple(r) for r in warc.round_trip(pages).collect())
    first = {}
    for p, _, h in rows:
        first[h or ""] = min(p, first.get(h or "", p))
    want = sorted((p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""]) for p, _, h in [*rows, rows[0]])
    assert sorted(got, key=str) == sorted(want, key=str)
    archives = warc.write_archives(pages)
    blocks, directory = warc.write_index(archives)
    assert directory == sorted(directory)
    one = warc.read_ranges(warc.find(warc.page_keys(pages.where("page_id = 2")), blocks, directory), archives, payload=True).collect()
    assert [(r["page_id"], bytes(r["payload"]).decode()) for r in one] == [(2, "é" * 3000)]
    assert warc.read_ranges(warc.find(spark.createDataFrame([("org,absent)/ 1",)], "key string"), blocks, directory), archives).count() == 0
    import gzip

    chunks = archives.where("archive is not null").orderBy("archive", "chunk").collect()
    assert gzip.decompress(b"".join(bytes(c["records"]) for c in chunks)).count(b"WARC/1.1") == len(rows) + 1
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_op9_one_key_in_several_blocks(spark):
    rows = [(i, f"http://h.org/{i}", f"<p>{i}</p>") for i in range(300)] + [(None, None, f"<p>{i % 50}</p>") for i in range(2 * warc.PER_BLOCK + 1)]
    rows += [(300, "http://h.org/300", "<p>again</p>")] * (warc.PER_BLOCK + 1) + [(i, f"http://h.org/{i}", None) for i in range(301, 400)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((str(r["page_id"]), r["payload_digest"]) for r in got) == sorted((str(p), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for p, _, h in rows)


def brute_kept(rows):
    seen, out = {}, []
    docs = {}
    for doc, t, *_ in rows:
        docs.setdefault(2**63 if doc is None else doc, t)
    kept = {}
    for doc in sorted(docs):
        w = (docs[doc] or "").encode().split()
        gone = set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone |= set(range(i, i + 20))
            seen.setdefault(key, doc)
        kept[doc] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    for doc, *_ in rows:
        out.append((doc, *kept[2**63 if doc is None else doc]))
    return out


def test_op10_windows(docs, rows):
    got = [tuple(r) for r in substrings.digest(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_kept(rows), key=str)
    assert sum(r[2] for r in got) > 200
    kept = substrings.deduplicated(docs)
    assert kept.columns == docs.columns and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    removed = {r[0]: r[1:3] for r in got}
    for r in kept.collect():
        n, gone = removed[r["doc_id"]]
        assert len((r["text"] or "").encode().split()) == n - gone and (gone or r["text"] == next(x[1] for x in rows if x[0] == r["doc_id"]))
    assert substrings.digest(none(docs)).count() == 0


def brute_parse(words, seen, doc, window):
    """Greedy factors of a document against all windows seen so far, word by word; seen: window -> (doc, start) of its first place."""
    out, i = [], 0
    places = dict(seen)
    hits = []
    for k in range(len(words) - window + 1):
        key = tuple(words[k : k + window])
        hits.append(places.get(key))
        places.setdefault(key, (doc, k))
    while i < len(hits):
        if hits[i] is None:
            i += 1
            continue
        n = 1
        while i + n < len(hits) and hits[i + n] == (hits[i][0], hits[i][1] + n):
            n += 1
        out.append((i, n + window - 1, *hits[i]))
        i += n
    seen.update({k: v for k, v in places.items() if k not in seen})
    return out


def test_op10_factors_are_those_of_a_greedy_parse(spark):
    rng = random.Random(21)
    pool = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(18, 60))] for _ in range(15)]
    rows = [(i, " ".join(w for _ in range(rng.randint(1, 5)) for w in rng.choice(pool))) for i in range(40)]
    rows = [(i, t) for i, t in rows if rows.index(next(r for r in rows if r[1] == t)) == i]  # whole copies need no parse
    found, _ = substrings.factors(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r["doc"]: [(f["start"], f["length"], f["doc"], f["at"]) for f in r["factors"]] for r in found.collect()}
    seen, want = {}, {}
    for i, t in rows:
        if factors := brute_parse(t.split(), seen, i, substrings.WINDOW):
            want[i] = factors
    # where a window stands in the document before and in an earlier one too, either reference will do
    cover = lambda fs: sorted({w for f in fs for w in range(f[0], f[0] + f[1])})
    assert {k: cover(v) for k, v in got.items()} == {k: cover(v) for k, v in want.items()} and len(want) > 10
    words = {i: t.split() for i, t in rows}
    assert all(words[k][a : a + n] == words[d][b : b + n] and n >= 20 and (d, b) < (k, a) for k, v in got.items() for a, n, d, b in v)


def test_op10_words_decide_not_hashes():
    mine = [f"{i}".encode() for i in range(60)]
    theirs = mine.copy()
    theirs[25] = b"other"
    assert substrings.equal_stretches(mine, mine, 20) == [(0, 60)] and substrings.equal_stretches(mine, theirs, 20) == [(0, 25), (26, 60)]
    assert substrings.equal_stretches(mine[:30], theirs[:30], 20) == [(0, 25)] and substrings.equal_stretches(mine, [], 20) == []
    block = lambda words: b" ".join(words)
    reference = {"start": 0, "length": 60, "at": 10}
    text = [b"x"] * 10 + theirs
    got = substrings.covered(mine, [reference | {"block": k, "words": block(text[k * 64 : (k + 1) * 64])} for k in (1, 0)], 20)
    assert np.flatnonzero(~got).tolist() == [25]
    assert not substrings.covered(mine, [reference | {"block": 0, "words": None}], 20).any()
    twice = mine[:20] * 2
    assert substrings.covered(twice, [{"start": 20, "length": 20, "at": 0, "block": -1, "words": None}], 20).tolist() == [False] * 20 + [True] * 20


def test_op10_random_repeats(spark):
    rng = random.Random(11)
    pool = [[f"{rng.choice('abc')}" for _ in range(rng.randint(15, 60))] for _ in range(12)]
    rows = [(i * 7 % 101, "\n".join(" ".join(rng.choice(pool)) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    got = [tuple(r) for r in substrings.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted(brute_kept(rows))


def test_op10_null_ids_are_documents_of_their_own(spark):
    rng = random.Random(12)
    unique = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    shared, between, short = unique(40), unique(30), unique(25)
    texts = [f"{unique(50)} {shared} {between}", f"{unique(9)} {between} {unique(70)}", short, short, f"{unique(3)} {shared}", None]
    table = spark.createDataFrame([(1, f"{shared} {unique(30)}"), *[(None, t) for t in texts]], "doc_id bigint, text string")
    order = {r["text"]: r["h"] for r in table.select("text", F.xxhash64("text").alias("h")).collect()}
    # one number for each text, null ids after the others and in the order of their hashes
    numbered = [(1, table.first()["text"])] + [(i, t) for i, t in enumerate(sorted(set(texts) - {None}, key=order.get), 2)]
    want = {t: r[1:] for (_, t), r in zip(numbered, brute_kept(numbered), strict=True)} | {None: (0, 0, hashlib.sha256(b"").hexdigest())}
    got = sorted(tuple(r) for r in substrings.digest(table).select("n_words", "n_removed", "kept_sha256").collect())
    assert got == sorted(want[r["text"]] for r in table.collect()) and sum(r[1] for r in got) == 40 + 40 + 30


def test_bloom_has_no_false_negatives(spark):
    f = common.bloom(spark.range(5000).select((F.col("id") * 977).alias("k")), "k")
    assert f.has(np.arange(0, 5000 * 977, 977, dtype=np.int64).view(np.uint64)).all()
    assert f.has(np.arange(1, 5000 * 977, 977, dtype=np.int64).view(np.uint64)).mean() < 0.2
    assert not common.bloom(spark.range(0).select(F.col("id").alias("k")), "k").has(np.array([1], np.uint64)).any()
