"""Each operator against a plain version, and over nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streamctx.llm import chat, components, dedup, jaccard, knn, langid, licenses, mixing, packing, sharding, sigtree, staging, text, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "é <|endoftext|> \\ </s>[INST] x"), (5, "é <|endoftext|> \\ </s>[INST] x"), (6, "w " * 30000), (7, "x" * 50000)]


def words(n, seed, vocabulary=500):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# --- exact dedup


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted((i, min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


@pytest.mark.parametrize("digest", [dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_dedup(documents, digest):
    rows = [*ODD, (10, "a  b"), (9, "a\tb"), (11, "a b "), *[(100 + i, f"t{i % 7}") for i in range(40)]]
    got = dedup.exact_dedup(documents(rows), digest=digest).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_dedup(rows)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({r.text_sha256 for r in got})  # one row of each text, of repeated rows too


def test_dedup_empty(documents):
    assert dedup.exact_dedup(documents([])).count() == 0


def test_dedup_over_several_batches(spark, documents):
    log = documents([(i, f"t{i % 5}") for i in range(50)]).select("doc_id", F.sha2("text", 256).alias("digest"), F.col("doc_id").cast("string").alias("locator"), F.lit("").alias("text_sha256")).repartition(5)
    from streamctx.llm import staging

    got = dedup.states(staging.stage(log, "test"), files_per_batch=1).collect()
    assert sorted((r["first"].doc_id, r.group_size) for r in got) == [(i, 10) for i in range(5)]


def test_dedup_of_repeated_ids_keeps_one(documents):
    rows = [(5, "a b"), (5, "a b"), (5, "a  b"), (6, "a b"), (None, "c"), (None, "c")]
    for digest in (dedup.sha256, lambda t: F.lit("0")):
        got = dedup.exact_dedup(documents(rows), digest=digest).collect()
        assert len(got) == 6 and sorted((r.keep_id or 0, r.group_size) for r in got if r.kept) == [(0, 2), (5, 4)]


def test_drop_copies_keeps_one_of_repeated_rows(spark, documents):
    from streamctx.llm import staging

    docs = staging.stage(documents([(5, "a b"), (5, "a b"), (6, "a  b"), (7, None)]), "test")
    got = dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [5, 7]


def test_dedup_orders_null_ids_last(spark, documents):
    from streamctx.llm import staging

    rows = [(None, "a b"), (7, "a  b"), (8, "a b"), (None, "c"), (None, "c"), (9, "d")]
    docs = staging.stage(documents(rows), "test")
    got = dedup.exact_dedup(docs, locator=dedup.place_in_file(docs)).collect()
    assert sorted(((r.doc_id or 0, r.keep_id, r.kept) for r in got), key=str) == sorted([(0, 7, False), (7, 7, True), (8, 7, False), (0, None, True), (0, None, False), (9, 9, True)], key=str)
    left = dedup.drop_copies(staging.stage(documents(rows), "test")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, "c"), (7, "a  b"), (9, "d")]


# --- sharding


def test_shards(documents):
    rows = [*ODD, *[(100 + i, words(5 + i % 40, i % 90)) for i in range(300)]]
    got = sharding.shard_rows(documents(rows), 8).collect()
    assert len(got) == len(rows)
    of, by = defaultdict(set), defaultdict(list)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    for r in got:
        by[r.shard].append(r)
        (t,) = texts[r.doc_id]
        of[t].add(r.shard)
        assert r["size"] == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode())
    assert all(len(s) == 1 for s in of.values())
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())


def test_differencing_is_tight_and_whole():
    r = random.Random(1)
    w = [r.randrange(1, 1000) for _ in range(500)]
    part = sharding.difference(w, 7)
    sums = Counter()
    for x, p in zip(w, part, strict=True):
        sums[p] += x
    assert len(sums) == 7 and max(sums.values()) - min(sums.values()) <= 3
    assert sharding.difference([], 3) == [] and sharding.difference([5], 3) == [0]
    assert sorted(sharding.difference([8, 7, 6, 5, 4], 2)) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])


def test_differencing_against_all_partitions():
    r, hits = random.Random(4), 0
    for _ in range(60):
        w, k = [r.randrange(1, 60) for _ in range(r.randrange(2, 8))], r.choice([2, 3])
        sums = lambda part, w=w, k=k: [sum(x for x, p in zip(w, part, strict=True) if p == s) for s in range(k)]
        best = min(max(sums(part)) for part in itertools.product(range(k), repeat=len(w)))
        got = max(sums(sharding.difference(w, k)))
        assert best <= got <= best * (4 / 3) + 1e-9
        hits += got == best
    assert hits > 40


def test_shards_of_few_parcels(documents):
    rows = [(i, words(10 + i % 30, i)) for i in range(400)] + [(1000 + i, "same text") for i in range(200)]
    sums = Counter()
    for r in sharding.shard_rows(documents(rows), 4, parcels=32).collect():
        sums[r.shard] += r["size"]
    assert max(sums.values()) < 1.3 * min(sums.values())
    assert sharding.shard_rows(documents([]), 4).count() == 0


def test_sharding_rows_without_ids_are_numbered_apart(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"), F.lit(1).alias("at"), F.lit(2).alias("cell"))
    got = sharding.shard_rows(rows, 4, parcels=64, cells=16)
    by_shard = {}
    for r in got.collect():
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, by_shard.values())) == 4000
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    same = {r["shard"] for r in got.where("size = 25").collect()}
    assert len(same) == 1


# --- mixing


def test_targets_reshare_what_is_above_the_limit():
    got = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert got[0] == 30 and got[1] == pytest.approx(1980 * 2 / 3) and got[2] == pytest.approx(1980 / 3)
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_knapsack_against_all_subsets():
    r = random.Random(3)
    for _ in range(50):
        lengths = r.sample(range(1, 40), 5)
        counts, budget = [r.randrange(4) for _ in lengths], r.randrange(80)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = mixing.knapsack(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert sum(n * t for n, t in zip(lengths, taken, strict=True)) == max(s for s in sums if s <= budget)


def test_mix(documents):
    rows = [(i, words(1 + i % 50, i), "en", f"s{i % 3}" if i % 10 else None) for i in range(600)] + [(9000, None, "en", "s0"), (9001, "", "en", "s0"), (3, words(4, 3), "en", "s0")]
    once, again = (sorted(map(tuple, mixing.mix(documents(rows)).collect()), key=str) for _ in range(2))
    assert once == again and len(once) == len(rows)
    taken, target = Counter(), {}
    for _, size, _, want, took, source, repeats in once:
        assert took == size * repeats <= 3 * size
        taken[source] += took
        target[source] = want
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)
    assert mixing.mix(documents([])).count() == 0


def test_mix_spreads_a_length_over_cells(documents):
    rows = [(i, "a b c d", "en", f"s{i % 2}") for i in range(500)]
    got = mixing.mix(documents(rows), cells=16).collect()
    took, want = Counter(), {r.source: r.target for r in got}
    for r in got:
        took[r.source] += r.taken
    assert all(abs(took[s] - want[s]) <= 4 for s in want)


# --- chat


def test_chat_round_trip(spark):
    odd = ["", "plain", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>\n", "\\", "\\!", "<\\!s>", "<s<s>", "[INST[INST]", "a\n\nb", "<<SYS>><</SYS>>", "\\\\n\\", None, "é" * 20000]
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(zip(["user", "assistant", "sys\ntem", None, "<|end|>\n"] * 3, odd, strict=False))]
    got = chat.format_turns(chat.to_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = got.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("m")).collect()
    for r in got:
        want = [(role or "", x or "") for c, _, role, x in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.t] == want
        assert r.m == "".join(x for role, x in want if role == "assistant")


def test_chat_layouts(spark):
    one = [("u", "a")]
    frames = [
        spark.sql("SELECT array(named_struct('role', 'user', 'content', 'u'), named_struct('role', 'assistant', 'content', 'a')) AS messages, 1 AS extra"),
        spark.sql("SELECT array(named_struct('from', 'human', 'value', 'u'), named_struct('from', 'gpt', 'value', 'a')) AS conversations"),
        spark.createDataFrame(one, "prompt string, response string"),
        spark.createDataFrame(one, "prompt string, completion string"),
        spark.createDataFrame([("u", "", "a")], "instruction string, input string, output string"),
    ]
    for df in frames:
        (r,) = chat.to_turns(df).collect()
        assert [(t.role, t.text) for t in r.turns] == [("user", "u"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.to_turns(spark.createDataFrame([(1,)], "x int"))
    prints = [chat.fingerprint(chat.paths(df.schema)) for df in frames]
    assert len(set(prints)) == len(prints)


def test_chat_more_layouts(spark):
    user, reply = ("user", "q"), ("assistant", "a")
    pair = "array<struct<role: string, content: string>>"
    for rows, schema, turns in [
        ([("q", "a")], "instruction string, output string", [user, reply]),
        ([("q", None, "a")], "instruction string, input string, output string", [user, reply]),
        ([("s", "q", "x", "a")], "system string, instruction string, input string, output string", [("system", "s"), ("user", "q\nx"), reply]),
        ([("q", "a", "b")], "prompt string, chosen string, rejected string", [user, reply]),
        ([("q", [user, reply], [user])], f"prompt string, chosen {pair}, rejected {pair}", [user, reply]),
        ([([("user", "q", 1), ("assistant", "a", None)],)], "messages array<struct<role: string, content: string, weight: int>>", [user, reply]),
        ([([("assistant", None, "f(1)"), ("tool", "1", None), ("assistant", "a", "g()")], 7)], "messages array<struct<role: string, content: string, tool_calls: string>>, x int", [("assistant", "f(1)"), ("tool", "1"), ("assistant", "a\ng()")]),
        ([("q", "a", 3)], "prompt string, response string, turns int", [user, reply]),
    ]:
        (r,) = chat.to_turns(spark.createDataFrame(rows, schema)).collect()
        assert [tuple(t) for t in r["turns"]] == turns, schema


def test_chat_ambiguous_layouts(spark):
    for schema in ("prompt string, response string, completion string", "prompt string, response string, instruction string, output string"):
        with pytest.raises(ValueError, match="all fit"):
            chat.select_mapping(spark.createDataFrame([], schema))
    with pytest.raises(ValueError, match="no mapping"):
        chat.select_mapping(spark.createDataFrame([], "messages array<struct<content: string>>"))


def test_chat_ties_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "n"), (1, 0, "user", "a")]
    (r,) = chat.to_turns(spark.createDataFrame(rows, schema)).collect()
    assert [t.text for t in r.turns] == ["n", "a", "a", "b"]
    assert chat.format_turns(chat.to_turns(spark.createDataFrame([], schema))).count() == 0


# --- packing


def test_pack_whole(documents):
    tokenizer = packing.Tokenizer.from_file(PATH)
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(100 + i, words(i * 7 % 900, i)) for i in range(120)]
    got = packing.pack(documents(rows), PATH, 512, group=40).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))] and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 512 for r in parts[1:]) and (len(parts) == 1 or len(ids) > 512)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)
    for rs in seq.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(p.length for p in rs[:k]) for k in range(len(rs))] and sum(r.length for r in rs) <= 512
    least = -(-sum(r.length for r in got) // 512)
    assert len(seq) <= least + 3
    assert packing.pack(documents([]), PATH).count() == 0


def test_place_follows_the_sum_of_squares():
    r, capacity = random.Random(5), 20
    lengths = np.array([r.randrange(1, 20) for _ in range(300)])
    got, gaps = packing.place(lengths, capacity), {}
    for n, b in zip(lengths.tolist(), got.tolist(), strict=True):
        def after(old, n=n):
            c = Counter(g for g in gaps.values() if g)
            c[old] -= 1
            if old > n:
                c[old - n] += 1
            return sum(v * v for v in c.values())

        room = {g for g in gaps.values() if g >= n}
        if b in gaps:
            assert gaps[b] >= n and after(gaps[b]) == min(map(after, room))
        else:
            assert not room
        gaps[b] = gaps.get(b, capacity) - n


@pytest.mark.parametrize("doc", ["x" + " " * 1_100_000 + "y", " " * 1_200_000, "\t" * 1_200_000 + "z", "x" + "\n" * 1_200_000 + "y", "a" + " " * 5000 + "<|endoftext|>b", "a" + "\r\n" * 3000 + "'s", "a" + "\u3000" * 2100 + "1", "a" + " " * 2500 + "b" + "\n" * 2100], ids=lambda d: f"{d[:3]!r} {len(d)}")
def test_ids_of_long_white_space(doc):
    ids = packing.ids_of(PATH)
    assert ids.fast and np.array_equal(ids.of(doc), ids.slow(doc))


def test_many_rows_of_one_id_and_text_are_dealt_apart(documents):
    rows = [(None, "a b c")] * 3000 + [(7, "x " * 300_000)]
    got = packing.pack(documents(rows), PATH, group=500).toPandas()
    assert len(got[got.doc_id.isna()]) == 3000 and (got[got.doc_id.isna()].sequence_id.values >> 32).max() >= 4
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all() and list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_ids_equal_the_tokenizers():
    tokenizer, ids = packing.Tokenizer.from_file(PATH), packing.Ids(PATH)
    r = random.Random(2)
    for t in ["", "<|endoftext|> a<|endoftext|>", "  x  \n\n y\t", "don't ٣٤ 漢字 é", *["".join(chr(r.choice([*range(32, 127), *range(0xA0, 0x500), 0x1F469, 10, 9])) for _ in range(60)) for _ in range(200)]]:
        assert ids.of(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_workers_keep_no_second_tokenizer():
    ids = packing.Ids(PATH)
    assert len(ids.of("a b")) and "tokenizer" not in vars(ids)
    ids.of("x" + " " * 5000 + "y")
    assert "tokenizer" in vars(ids)


def test_mix_needs_no_python_rdd(documents):
    # workers of RDDs stay beside those of SQL, with the memory of both
    mixed = mixing.mix(documents([(1, "a b", "en", "s0"), (2, "c", "en", None)]))
    assert "ExistingRDD" not in mixed._jdf.queryExecution().toString() and mixed.count() == 2


def test_staged_batches_are_narrow(spark):
    sizes = text.batches(lambda b: pa.record_batch([pa.array([b.nbytes])], ["n"]))
    rows = spark.range(8000, numPartitions=1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    assert max(r.n for r in staging.stage(rows.mapInArrow(sizes, "n long"), "test").collect()) < 5 << 20


# --- licences


def test_licenses(documents):
    base = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "licensed under the GNU General Public License, version 3.", "MIT  LICENSE mit license", "mit. License: apache", "the gnu lesser general public license as published by the free software foundation under the terms of the"]
    rows = [*ODD, *[(100 + i, f"{words(40, i)} {t} {words(30, -i)}") for i, t in enumerate(base)]]
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(rows)).collect()}
    for i, t in rows:
        ws, starts, labels = pattern.findall((t or "").translate(low)), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            here = [k for k in range(len(ws)) if ws[k : k + len(p)] == p]
            starts += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[101].labels == "apache,apache-2.0" and got[102].labels == "gpl,gpl-3.0" and got[101].score == 1
    assert licenses.scan_licenses(documents([])).count() == 0


def test_licenses_against_every_start():
    """Template labels and scores against a look at each template at each start."""
    index, r = licenses.Index({b"the": 90, b"license": 40, b"under": 30}, 100), random.Random(6)
    pieces = [t.words for t in licenses.TEMPLATES] + [k for t in licenses.TEMPLATES for k in t.keys] + [p for p, _ in licenses.PHRASES]
    found = set()
    for n in range(300):
        chosen = [r.choice(pieces).split() for _ in range(r.randrange(4))]
        for c in chosen:
            for _ in range(r.randrange(4)):
                c[r.randrange(len(c))] = r.choice(["x", "the", "license"])
        ws = [w.encode() for c in chosen for w in [*c, *(["filler"] * r.randrange(3))]]
        labels, score, base = set(), 0.0, set()
        for phrase, label in licenses.PHRASES:
            p = phrase.encode().split()
            if any(ws[k : k + len(p)] == p for k in range(len(ws))):
                base.add(label)
                score = 0.5
        for t in licenses.TEMPLATES:
            words_, keys = t.words.encode().split(), [k.encode().split() for k in t.keys]
            rare = sorted(range(len(words_)), key=lambda i: (-index.idf[words_[i]], words_[i], i))[:12]
            for start in range(-len(words_), len(ws)):
                there = [i for i, w in enumerate(words_) if 0 <= start + i < len(ws) and ws[start + i] == w]
                same = len(there)
                span = ws[max(0, start - index.slack) : max(0, start + len(words_) + index.slack)]
                weight = lambda at, w=words_: index.idf[w[at]]
                if 2 * sum(weight(i) for i in rare if i in there) >= sum(map(weight, rare)) and all(any(span[i : i + len(k)] == k for i in range(len(span))) for k in keys):
                    labels.add(t.label)
                    score = max(score, same / len(words_))
        got = index.scan(ws)
        assert (set(got[1]), set(got[2]), got[3]) == (base, base | labels, score), n
        found |= labels
    assert len(found) > 8
    both = itertools.combinations(licenses.TEMPLATES, 2)
    assert all({a.label, b.label} <= set(index.scan(f"{a.words} word {b.words}".encode().split())[2]) for a, b in both)


def test_licenses_with_thousands_of_templates(documents):
    """What a file costs follows from the rare words it has, not from the number of templates."""
    own = [licenses.Template(f"t{i}", f"use of the work number{i} is granted by holder{i} under the terms of the charter{i} license", (f"number{i} is granted", f"charter{i} license")) for i in range(3000)]
    texts = [f"{words(300, i)} {own[7 * i].words} {words(200, -i)} the license of the terms under the use of" for i in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(rows).withColumn("labels", F.lit("x")), templates=own).collect()}
    assert all(got[i].labels == f"t{7 * i}" and got[i].score == 1 for i in range(20))
    index = licenses.Index({w.encode(): 20 for w in "use of the work is granted by under terms license".split()}, 20, own)
    for t in texts:
        ws = [w.encode() for w in t.split()]
        places = {w: [i for i, x in enumerate(ws) if x == w] for w in index.asked.intersection(ws)}
        assert 1 <= len(index.starts(places)) < 10


def test_licenses_null_ids_and_empty_templates(spark):
    docs = spark.createDataFrame([(None, "released under the mit license"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan_licenses(docs).collect()), key=str)
    assert got == [(None, 0, 0, None, None, "", "", 0.0), (None, 5, 1, 3, 3, "mit", "mit", 1.0)]
    assert sorted(r.labels for r in licenses.scan_licenses(docs, templates=()).collect()) == ["", "mit"]


def test_licenses_in_one_very_long_text(documents):
    passages = {t.label: t.words for t in licenses.TEMPLATES if t.label in ("bsd", "isc", "mpl-2.0", "unlicense", "cc-by")}
    passages["mit"] = licenses.TEMPLATES[1].words
    rare = " ".join(sorted(w.decode() for w in licenses.vocabulary()))
    long = " ".join([words(20000, 1), rare, *(f"{words(3000, n)} {t}" for n, t in enumerate(passages.values())), words(9000, 2)])
    rows = [(0, long), *[(1 + n, f"{words(30, n)} {t} {rare}") for n, t in enumerate(passages.values())], (90, " ".join(passages.values())), (91, f"{rare} {words(500, 3)}")]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(rows)).collect()}
    for i in (0, 90):
        assert got[i].labels == ",".join(sorted(passages)) and got[i].score == 1
    for n, label in enumerate(passages):
        assert got[1 + n].labels == label and got[1 + n].score == 1
    assert got[91].labels == ""


# --- top k


def plain_top(rows, k, every):
    vs = [(i, np.floor(256 * np.array(v, float)).astype(object)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wide = max(len(v) for _, v in vs)
    vs = [(i, np.concatenate([v, np.zeros(wide - len(v), object)])) for i, v in vs]
    out = []
    for q, v in vs:
        if q % every == 0:
            best = sorted((-int((v * w).sum()), i) for i, w in vs if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("clustered", [False, True])
def test_top_k(spark, clustered):
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 8)) * 5
    rows = [(i, (centres[i % 6] * clustered + r.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2010, [1.0, None]), (2020, [float("nan")] * 8), (2030, [float("inf")] * 8), (2040, [0.0] * 8), (2050, [1.0, 2.0]), (2060, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = knn.top_k(df, 5, every=10, n_pivots=8, queries_per_group=6, block=90)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 5, 10)


def test_top_k_of_very_large_components(spark):
    big = [0.0, 2.0**20, -(2.0**20), 2.0**40, 3e38, -3e38, 1.5, 2.0**22 + 0.5]
    r = random.Random(9)
    rows = [(i, [r.choice(big), r.choice(big) if i % 3 else 1.0, float(r.randrange(9))]) for i in range(60)]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 5, every=10, n_pivots=8, block=20)
    ends = lambda x: max(-(2**63), min(2**63 - 1, x))
    vs = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows]
    want = []
    for q, v in vs[::10]:
        best = sorted((-ends(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in vs if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_sends_what_the_bounds_leave():
    r = np.random.default_rng(3)
    pivots = np.repeat(np.eye(16) * 1000, 2, axis=0) + r.normal(size=(32, 16))
    counts, vectors = np.full(32, 50), np.full(32, 2500.0)
    far = np.linspace(0, 10, 17)[None].repeat(32, axis=0)
    near = knn.bounds(pivots, pivots, np.sort(r.random((32, 6)), axis=1), 5)
    group = knn.grouping(pivots, counts, far, vectors, near)
    share = np.mean([(far >= near[group == g].min(axis=0)[:, None]).mean() for g in range(group.max() + 1)])
    assert group.max() + 1 >= 8 and share < 0.3  # clustered: each group needs few vectors
    assert knn.grouping(pivots, counts, far, vectors, np.full((32, 32), -1.0)).max() == 0  # nothing pruned: each vector is sent once


def test_top_k_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert knn.top_k(spark.createDataFrame([], schema)).count() == 0
    got = knn.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 512)]


def test_top_k_of_repeated_query_ids(spark):
    r = np.random.default_rng(6)
    rows = [(0, [10.0, 0.0, 0.0])] * 8 + [(1 + i, [9.9, 0.1 * i, 0.0]) for i in range(2)]
    rows += [(100 + i, (np.array([3.0, 8.0, 1.0]) + r.normal(size=3) * 0.2).tolist()) for i in range(60)]
    rows += [(200 + i, (np.array([-6.0, 1.0, 7.0]) + r.normal(size=3) * 0.2).tolist()) for i in range(60)]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 5, every=1000, n_pivots=200, queries_per_group=2, block=50)
    plain = [(i, np.float32(v).tolist()) for i, v in rows]
    want = [x for x in plain_top([plain[0], *(x for x in plain if x[0])], 5, 1000)]
    assert sorted(map(tuple, got.collect())) == want


# --- n-gram Jaccard join


def plain_sets(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[top(x)] = top(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[top(x)] = min(i, least.get(top(x), i))
    return sorted((i, len(s), least[top(x)]) for x, (i, s) in enumerate(sets))


def edited(t, edits, seed):
    w, r = t.split(), random.Random(seed)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("few, block", [(16, 512), (2, 4)])
def test_jaccard(documents, few, block):
    passage = words(60, 99)
    rows = list(ODD)
    for b in range(12):
        t = words(80 + 30 * (b % 4), b)
        rows += [(1000 * (b + 1) + e, edited(t, e, b * 50 + e)) for e in range(9)]
    rows += [(50000 + i, f"{words(30, i + 7000)} {passage} {words(i % 30, i)}") for i in range(25)]
    rows += [(60000 + i, t) for i, t in enumerate(["one", "One", "one two", "a b c d e", "A b c d  e", "b c d e f"])]
    got = jaccard.near_duplicates(documents(rows), few=few, block=block)
    assert sorted(map(tuple, got.collect())) == plain_components(rows)


def test_jaccard_template_with_one_word_varied(documents, monkeypatch):
    rows = [(i, f"{'fixed ' if i % 2 else 'other '}words of one long template here x{i}") for i in range(600)]
    rows += [(1000 + i, f"fixed words of one long template here {words(12, 5)} {words(i % 4, i)}") for i in range(12)]
    made, stage = {}, jaccard.staging.stage

    def counting(df, name):
        out = stage(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard.staging, "stage", counting)
    got = jaccard.near_duplicates(documents(rows), few=2, block=4)
    assert sorted(map(tuple, got.collect())) == plain_components(rows)
    assert made["jaccard-members"] < 2 * len(rows) and made["jaccard-left"] < len(rows)


def test_jaccard_overlapping_groups_are_walked_together(spark):
    # nine groups with class 1 (sets 0 to 5), which share most sets; and two with class 2 (set 100) that share no other set
    groups = {g: (1, [*range(6), *range(10, 18 + g % 2)]) for g in range(9)} | {20: (2, [100, *range(101, 108)]), 21: (2, [100, *range(108, 115)])}
    rows = [(g, s, 5, 1 if s < 6 else 2 if s == 100 else s, most, len(sets)) for g, (most, sets) in groups.items() for s in sets]
    met = jaccard.staging.stage(spark.createDataFrame(rows, "list long, set_id long, n long, comp long, most long, m long"), "met")
    out, read = jaccard.together(met, met.select("list", "most", "m").distinct(), 8)
    got = out.collect()
    jaccard.staging.drop(met, *read)
    assert sorted(r["set_id"] for r in got if r["most"] == 1) == [*range(6), *range(10, 19)]
    assert {(r["most"], r["m"]) for r in got} == {(1, 15), (2, 8)} and len({r["list"] for r in got}) == 3
    met_in = {frozenset((a["set_id"], b["set_id"])) for a in got for b in got if a["list"] == b["list"]}
    assert {frozenset((a, b)) for _, sets in groups.values() for a in sets for b in sets} <= met_in


@pytest.mark.parametrize("hot", [3, 12])
def test_jaccard_hot_groups(documents, hot):
    passage = words(40, 99)
    rows = [(i, f"{edited(passage, i % 8, i)} {words(i % 11, i)}") for i in range(150)]
    sentences = [words(6, 500 + k, 10**6) for k in range(9)]
    rows += [(1000 + i, " ".join(random.Random(i).sample(sentences, 5 + i % 4))) for i in range(150)]
    rows += [(2000 + i, " ".join(sorted(random.Random(i).sample(sentences, 3 + i % 6)))) for i in range(100)]
    got = jaccard.near_duplicates(documents(rows), few=2, block=4, hot=hot)
    assert sorted(map(tuple, got.collect())) == plain_components(rows)


def test_jaccard_links_through_null_and_shared_ids(documents):
    from streamctx.llm import staging

    t = words(80, 1, 10**6).split()
    step = lambda n: " ".join(["z"] * n + t[n:])
    rows = [(4, step(0)), (None, step(7)), (3, step(14)), (5, step(1)), (5, words(50, 2)), (5, words(50, 2) + " x"), (None, words(50, 3)), (None, None)]
    docs = staging.stage(documents(rows), "test")
    got = jaccard.near_duplicates(docs, locator=dedup.place_in_file(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got)
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[4, 76].component_id == 3 and by[5, 76].component_id == 3 and not by[4, 76].kept and not by[5, 76].kept
    assert sorted(r.n_shingles for r in got if r.kept and r.doc_id is None) == [0, 46]
    assert sum(r.kept for r in got if r.doc_id == 5) == 1 and sum(r.kept for r in got) == 4


def test_jaccard_empty(documents):
    assert jaccard.near_duplicates(documents([])).count() == 0
    assert [tuple(r) for r in jaccard.near_duplicates(documents([(4, None), (3, " ")])).orderBy("doc_id").collect()] == [(3, 0, 3), (4, 0, 4)]


@pytest.mark.parametrize("sides, kinds", [(False, False), (True, False), (False, True), (True, True)])
def test_tree_loses_no_link(sides, kinds):
    r = np.random.default_rng(0)
    sets = []
    for _ in range(30):
        base = r.integers(0, 2**64, int(r.integers(5, 300)), dtype=np.uint64)
        for keep in (1, 0.95, 0.9, 0.85, 0.5):
            sets.append(np.unique(np.concatenate([base[: int(keep * len(base))], r.integers(0, 2**64, int(r.integers(0, 9)), dtype=np.uint64)])))
    n = len(sets)
    entries = sigtree.Entries(np.arange(n) // 100, r.integers(0, 2, n) if sides else np.full(n, -1), np.array([len(s) for s in sets]), r.integers(0, 4, n) if kinds else np.arange(n))
    out = sigtree.forest([sigtree.bitmap(s).tobytes() for s in sets], entries)
    found = [frozenset((x, y)) for i, j in out for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(set(found)) == len(found)
    found, wanted = set(found), set()
    for x in range(n):
        for y in range(x):
            meet = x // 100 == y // 100 and (not sides or entries.side[x] != entries.side[y]) and entries.kind[x] != entries.kind[y]
            both = len(np.intersect1d(sets[x], sets[y]))
            if meet and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                wanted.add(frozenset((x, y)))
            assert meet or frozenset((x, y)) not in found
    assert wanted <= found and len(found) < 2 * len(wanted) + 20


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for n in got:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m), todo.append(m)
        assert got[n] == min(seen)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_edges_and_rounds(spark):
    many = spark.range(20_000_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.state(many)[0] == 20_000_000
    assert components.state(many) == components.state(many.repartition(3)) != components.state(many.withColumn("b", F.col("b") + (F.col("a") == 7).cast("long")))
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(path, most_rounds=2)
    assert {r.component for r in components.components(path, most_rounds=20).collect()} == {0}


# --- toxicity and language


def test_toxicity(spark, documents):
    bad = ["slurone", "slurtwo", "slurthree"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        r = random.Random(i)
        t = words(40, i, 300).split() + [r.choice(bad) for _ in range(3)] * toxic
        r.shuffle(t)
        rows.append((i, " ".join(t)))
        if i % 2:
            labels.append((i, 0, 0))
        elif i % 4 == 0 or i % 6 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(10000 + i, t) for i, (_, t) in enumerate(ODD)]
    frame = spark.createDataFrame([*labels, (0, 1, 1), (77777, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(documents(rows), frame).collect()
    assert len(got) == len(rows)
    right = [(r.predicted == (r.doc_id % 6 == 0)) for r in got if r.doc_id < 900 and r.held_out]
    assert sum(right) / len(right) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.toxicity(documents(rows[:5]), frame.where("false")).collect()
    assert [r.score for r in none] == [0.0] * 5
    assert toxicity.toxicity(documents([]), frame).count() == 0


def test_the_risk_and_its_slope():
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 12, 5)).astype(np.int32) for _ in range(30)]
    sample = toxicity.Sample(rows[:10], rows[10:], 0.2, least=1)
    for scale in (0.3, 3.0, -3.0):
        w = r.normal(size=len(sample.seen) + 1) * scale
        g = np.array([sum(w[np.searchsorted(sample.seen, f)] for f in row) + w[-1] for row in rows])
        pos = lambda x: np.log1p(np.exp(-x)).mean()
        first, second = 0.2 * pos(g[:10]), pos(-g[10:]) - 0.2 * pos(-g[:10])
        got = sample.risk(w)
        assert np.allclose(got[:2], (first, second))
        whole = lambda v: sum(sample.risk(v)[:2]) if second >= 0 else -sample.risk(v)[1]
        for k in range(len(w)):
            step = np.eye(len(w))[k] * 1e-5
            assert abs((whole(w + step) - whole(w - step)) / 2e-5 - got[2][k]) < 1e-6


def test_the_risk_is_corrected_by_the_prior():
    r = np.random.default_rng(1)
    sample = lambda toxic: np.unique(np.concatenate([r.integers(100, 400, 20), [1, 2] if toxic else []])).astype(np.int32)
    pos, mixed = [sample(True) for _ in range(300)], [sample(i % 10 == 0) for i in range(2000)]
    w = toxicity.fit(pos, mixed, 0.1)
    assert w[1] + w[2] + w[-1] > 0 > w[-1]


def test_toxicity_is_fitted_to_its_end():
    """Twice the steps change nothing much: the fit isn't stopped on its way."""
    r = np.random.default_rng(5)
    sample = lambda toxic: np.unique(np.concatenate([r.integers(1000, 9000, 150), r.integers(0, 60, 4) if toxic else []])).astype(np.int32)
    pos, rest = [sample(True) for _ in range(600)], [sample(i % 10 == 0) for i in range(1800)]
    cost = lambda w, s: (lambda a, b: a + max(0, b))(*s.risk(np.append(w[:-1][s.seen], w[-1]))[:2])
    whole = toxicity.Sample(pos, rest, 0.1)
    once, twice = (cost(toxicity.fit(pos, rest, 0.1, **how), whole) for how in ({}, {"steps": 400}))
    short = cost(toxicity.fit(pos, rest, 0.1, steps=60), whole)
    assert once < 1.6 * twice + 0.002 and once < short


def test_toxicity_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    w = toxicity.train(docs, labels, fold=fold)
    assert (w[:-1] < 0).any() and (w[:-1] > 0).sum() > 50
    got = toxicity.score(docs, w, ~fold).where("held_out").join(labels, "doc_id").collect()
    bad, clean = [r.score for r in got if r.toxic == 1], [r.score for r in got if r.toxic == 0]
    assert np.mean(np.array(bad) >= 0.5) >= 0.9 and np.mean(np.array(clean) >= 0.5) <= 0.01
    assert len({round(x, 9) for x in bad + clean}) > 100


def test_reject_keeps_columns_and_order_of_types(spark, documents):
    rows = [(i, t) for i, t in enumerate([None, "", "fine words", "slur slur"])]
    w = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    w[-1], w[next(iter(toxicity.features({b"slur"})))] = -1, 5
    docs = documents(rows)
    left = toxicity.reject(docs, w)
    assert left.schema == docs.schema and sorted(r.doc_id for r in left.collect()) == [0, 1, 2]
    assert "BatchEvalPython" not in (plan := left._jdf.queryExecution().executedPlan().toString()) and "ArrowEvalPython" in plan


def plain_ngrams(raw):
    """The n-grams of 1 to 4 characters of each lower-cased word of letters, with a space at its ends."""
    out = []
    for word in "".join(c if c.isalpha() else " " for c in raw.lower()).split(" "):
        w = f" {word} " if word else ""
        out += [w[i : i + n] for n in range(1, 5) for i in range(len(w) - n + 1) if w[i : i + n].strip() and (n > 1 or w[i] != " ")]
    return [g for g in out if " " not in g[1:-1]]


def test_ngrams():
    r = random.Random(2)
    texts = ["", "½ ² ①", "a", "ab c", "Été 漢字", "don't", "x1y_z", "\U0001f469 q"] + ["".join(r.choice("abcé 1-") for _ in range(r.randrange(30))) for _ in range(200)]
    for t in texts:
        assert langid.ngrams(t).sum() == len(plain_ngrams(t)), t
        assert (langid.ngrams(t) == sum((langid.ngrams(w) for w in re.split(r"[^a-zA-Zéàèùç漢字É]", t)), np.zeros(langid.WIDTH, np.int64))).all() or not t.isascii()
    assert (langid.ngrams("aB") == langid.ngrams("AB")).all() and (langid.ngrams("ab") != langid.ngrams("ba")).any()


def test_families_then_machines_of_pairs():
    r = np.random.default_rng(5)
    centre = {lang: r.random(langid.WIDTH) * (r.random(langid.WIDTH) < 0.02) for lang in ("en", "de", "fr", "es", "xx")}
    y = np.array([*centre] * 40)
    x = np.array([centre[lang] + r.random(langid.WIDTH) * 0.05 for lang in y], np.float32)
    x /= x.sum(axis=1, keepdims=True)
    model = langid.Model(x, y)
    assert model.families == ["germanic", "romance", "xx"] and model.pairs == [("germanic", "de", "en"), ("romance", "es", "fr")]
    for v, lang in zip(x, y, strict=True):
        margins = model.weights[:, :-1] @ v + model.weights[:, -1]
        of = model.families[int(np.argmax(margins[:3]))]
        want = {"germanic": "de" if margins[3] >= 0 else "en", "romance": "es" if margins[4] >= 0 else "fr", "xx": "xx"}[of]
        got, sure = model.decide(margins)
        assert got == want == lang and 0.5 < sure <= 1


def test_languages(documents):
    letters = {"en": "th wh ing ed er", "de": "sch ung ein ch pf", "fr": "eau oi ent que ou", "es": "cion ado ll rr ez"}
    rows = []
    for i in range(600):
        lang = list(letters)[i % 4]
        r = random.Random(i)
        parts = letters[lang].split()
        rows.append((i, " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(12)), lang))
    rows += [(10000 + i, t, None) for i, (_, t) in enumerate(ODD)]
    got = {r.doc_id: r for r in langid.identify(documents(rows)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.97 and all(got[i].held_out for i in held)
    assert [got[10000 + i].lang_pred for i in range(3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(documents([])).count() == 0
    assert langid.identify(documents([(1, "abc", None)])).collect()[0].lang_pred == "und"


def test_shingles_of_odd_texts():
    pieces = ["", "a b", "a " * 20, "A " * 4, "x" * 200000 + " b c d e f", " " * 300000, "w1 w2\tw3 w4 w5 w6\n" * 9000, "é É straße b c", None, "a b c d e", "b", "a\x00b c\x1fd"]
    r = random.Random(3)
    pieces += ["".join(r.choice("ab A\t\n\x0b é") for _ in range(r.randrange(60))) for _ in range(300)]
    want = [s for _, s in plain_sets(list(enumerate(pieces)))]
    for slab in (16, 1000, 1 << 20):
        got = list(text.shingle_sets(pa.array([None, *pieces], pa.string()).slice(1), slab=slab))
        assert [len(s) for s in got] == [len(s) for s in want]
        of = {}
        for mine, theirs in zip(got, want, strict=True):
            assert (np.diff(mine.view(np.uint64)) > 0).all() if len(mine) > 1 else True
            assert of.setdefault(frozenset(theirs), mine.tobytes()) == mine.tobytes()
        assert len(set(of.values())) == len(of)
