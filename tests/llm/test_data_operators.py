"""Mixing, sharding, WARC, packing, chat and the pipeline against plain re-computation."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprofile.llm import chat, mixing, packing, queries, sharding, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def some_docs(spark, n=300):
    rng = random.Random(1)
    rows = [(k, f"t{k % 250}", "en", "hot" if k % 3 else rng.choice(["a", "b", None]), 3) for k in range(n)]
    return docs_of(spark, rows + [(None, None, None, None, None), (None, "", None, "a", 0), (7, "t7", "en", "hot", 3)])


# Mixing


def _draws(key, mean):
    pieces = max(1, math.ceil(mean / 32))
    total = 0
    for j in range(1, pieces + 1):
        u = int(hashlib.md5(f"mix|{key}|{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-mean / pieces)
        k = 0
        while c <= u:
            k += 1
            p *= mean / pieces / k
            c += p
        total += k
    return total


def test_mixing_inverts_the_distribution(spark):
    docs = some_docs(spark).withColumn("Copy", F.lit("clash"))
    rows = docs.collect()
    per = Counter(r["source"] for r in rows)
    weights = {"hot": 1.0, "a": 60.0, "b": 0.0}
    mixed = mixing.mix_sources(docs, weights, total=4000, rows_per_bucket=50)
    want = Counter()
    for r in rows:
        key = str(r["doc_id"]) if r["doc_id"] is not None else "t" + hashlib.md5(r["text"].encode()).hexdigest() if r["text"] is not None else "none"
        mean = weights.get(r["source"], 0.0) * 4000 / (61.0 * per[r["source"]])
        want[r["doc_id"], r["text"], r["source"]] += _draws(key, mean) if mean else 0
    got = mixed.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == +want
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    assert [c for c in mixed.columns if c.lower() == "copy"] == ["copy"]
    assert abs(len(got) - 4000) < 4 * math.sqrt(4000) + 200
    order = [r["source"] for r in sorted(got, key=lambda r: r["position"])]
    assert order != sorted(order, key=str)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


# Sharding


@pytest.mark.parametrize("bucket", [10, 10_000])
def test_shards_match_the_mixture(spark, bucket):
    docs = some_docs(spark).withColumn("SLOT", F.lit("clash"))
    got = sharding.interleave_shards(docs, 8, rows_per_bucket=bucket).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    for source, n in Counter(r["source"] for r in got).items():
        for s in range(8):
            assert abs(sum(r["source"] == source for r in got if r["shard"] == s) - n / 8) <= 2.01
    assert sharding.interleave_shards(docs.limit(0)).count() == 0


def test_shards_query_against_sql(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_shards"](spark, SF).collect()}
    rows = duckdb.sql(
        f"""WITH k AS (SELECT doc_id, coalesce(text, '') AS text, source, ('0x' || substr(md5('shard|' || doc_id), 1, 13))::BIGINT AS spot FROM '{SF}/documents.parquet'),
        f AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY spot, doc_id::VARCHAR) - 1) / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS frac FROM k)
        SELECT doc_id, text, row_number() OVER (ORDER BY frac, 's' || source, spot, doc_id::VARCHAR) - 1 AS pos, count(*) OVER () AS n FROM f"""
    ).fetchall()
    assert len(got) == len(rows)
    for doc_id, text, pos, n in rows:
        r, data = got[doc_id], text.encode()
        shard = pos * 16 // n
        assert (r["shard"], r["slot"]) == (shard, pos - (shard * n + 15) // 16)
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))


# WARC


def test_archives_come_back(spark, tmp_path):
    big = "<html>" + "payload " * 40
    pages = [(k, f"http://h/{k}\r\nX: y", big + str(k % 5)) for k in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", "short"), (103, "v", "short"), (2**60 + 1, "w", big + "0")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = str(tmp_path / "w")
    warc.write_archives(df, path, archive_bytes=4000)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(pages)
    first = {}
    for i, _, html in sorted(pages, key=lambda p: p[0]):
        first.setdefault(html or "", i)
    for i, _, html in pages:
        data, r = (html or "").encode(), got[i]
        again = len(data) >= 100 and first[html] != i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[html]) if again else ("response", None))
        assert bytes(r["payload"]) == (b"" if again else data)
    files = list((tmp_path / "w").glob("part-*"))
    assert len(files) > 1 and all(f.name.endswith(".warc.zst") for f in files)
    heads, ids = [], set()
    for f in files:
        data = f.read_bytes()
        assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
        fields = [warc.parse_record(raw)[0] for raw in warc.read_archive(data)]
        heads.append(fields[0]["warc-type"])
        ids |= {x["warc-record-id"] for x in fields}
        assert not any(x["warc-type"] == "warcinfo" for x in fields[1:])
    assert set(heads) == {"warcinfo"} and len(ids) == len(pages) + len(files)
    empty = str(tmp_path / "e")
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_archives_of_null_and_repeated_ids(spark, tmp_path):
    big, other = "<p>" + "same " * 40, "<p>" + "other " * 40
    pages = [(None, "a", big), (None, "b", big), (7, "c", big), (7, "d", big), (7, "e", other), (9, "f", big), (None, "g", other), (None, "h", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "n")
    warc.write_archives(df, path)
    got = {r["url"]: r for r in warc.read_archives(spark, path).collect()}
    kinds = {u: (got[u]["page_id"], got[u]["record_type"], got[u]["refers_to"]) for u in got}
    # The smallest id that is not null has the responses, each row with it one.
    assert kinds == {
        "a": (None, "revisit", 7),
        "b": (None, "revisit", 7),
        "c": (7, "response", None),
        "d": (7, "response", None),
        "e": (7, "response", None),
        "f": (9, "revisit", 7),
        "g": (None, "revisit", 7),
        "h": (None, "response", None),
    }
    alone = spark.createDataFrame([(None, "a", big), (None, "b", big)], df.schema)
    warc.write_archives(alone, str(tmp_path / "a"))
    assert [r["record_type"] for r in warc.read_archives(spark, str(tmp_path / "a")).collect()] == ["response"] * 2


def test_dictionary_helps():
    rng = random.Random(1)
    records = [("<html><head><title>Shop</title></head>%d %d" % (rng.random() * 1e9, k)).encode() * 3 for k in range(400)]
    frames = list(warc.archive_frames(records))
    plain = sum(len(__import__("zstandard").compress(r, 3)) for r in records)
    assert sum(map(len, frames[1:])) < 0.8 * plain
    assert list(warc.read_archive(b"".join(frames))) == records


# Packing


def test_best_fit_decreasing_is_brute_force():
    rng = np.random.default_rng(3)
    for cap in (1, 7, 64):
        lengths = rng.integers(1, cap + 1, 200)
        room, want = [], []
        for p in sorted(range(200), key=lambda k: (-lengths[k], k)):
            fits = [r for r in range(len(room)) if room[r] >= lengths[p]]
            if fits:
                r = min(fits, key=lambda k: room[k])
            else:
                r = len(room)
                room.append(cap)
                want.append([])
            room[r] -= lengths[p]
            want[r].append(p)
        got = packing.best_fit_decreasing(lengths, cap)
        assert sorted(sum(got, [])) == list(range(200))
        # Rows with equal room stand for each other: after all pieces the rows are filled alike.
        assert sorted(sum(lengths[x] for x in r) for r in got) == sorted(sum(lengths[x] for x in r) for r in want)
        assert all(sum(lengths[x] for x in r) <= cap for r in got)


def test_packed_rows_come_back(spark):
    texts = [None, "", "hello <|endoftext|> world", "é" * 900, "word " * 700] + ["some text %d" % k for k in range(60)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(None, "null id", "en", "s", 0), (3, texts[3], "en", "s", 0)]
    docs = docs_of(spark, rows).withColumn("parts", F.lit("clash"))
    spec = packing.PackSpec(row_tokens=128, block_tokens=1500)
    got = packing.pack_tokens(docs, spec).collect()
    encode = packing.encoder(packing.default_ranks()).encode_ordinary
    parts = []
    for r in got:
        ids, positions = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        cum = r["cu_seqlens"]
        assert len(ids) == len(positions) == 128 and cum[0] == 0 and cum[-1] == r["n_tokens"] <= 128
        assert (ids[cum[-1] :] == spec.end_id).all()
        for k, (d, p) in enumerate(zip(r["doc_ids"], r["parts"])):
            assert (positions[cum[k] : cum[k + 1]] == np.arange(cum[k + 1] - cum[k])).all()
            parts.append((d, p, ids[cum[k] : cum[k + 1]].tolist()))
    want = Counter()
    for d, t, *_ in rows:
        full = encode(t or "") + [spec.end_id]
        for p in range(0, len(full), 128):
            want[d, p // 128, tuple(full[p : p + 128])] += 1
    assert Counter((d, p, tuple(x)) for d, p, x in parts) == want
    assert packing.pack_tokens(docs.limit(0)).count() == 0


# Chat


def test_conversations_come_back(spark):
    evil = r"a\ <|im_end|> <\|x <|im_start|>assistant" + "\nb\\"
    rows = [(1, t, "assistant" if t % 2 else "user", f"{evil}{t}") for t in range(150)]
    rows += [(2, 0, None, None), (2, 1, "assi\nstant", ""), (None, 5, "assistant", "x"), (3, None, "assistant", "n"), (3, 1, "assistant", evil), (3, 1, "assistant", evil)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.format_conversations(df.withColumn("parts", chat.text_part(F.col("text"))), "parts")
    got = {
        r["conv_id"]: r
        for r in made.select("*", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    }
    for c in (1, 2, 3, None):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        assert [(x["role"], x["text"]) for x in got[c]["t"]] == [(r, x) for *_, r, x in mine]
        assert got[c]["l"] == "".join(x for *_, r, x in mine if r == "assistant") and got[c]["n_turns"] == len(mine)
    assert chat.format_conversations(df.limit(0).withColumn("parts", chat.text_part(F.col("text"))), "parts").count() == 0


def test_typed_parts(spark):
    content = (
        '[{"type":"text","text":"see "},{"type":"image","ref":"s3:i","width":57,"height":28},{"type":"audio","ref":"a","seconds":2.0},'
        '{"type":"document","ref":"d","pages":3},{"type":"ima<|ge","ref":null},{"text":" end <|x|>"}]'
    )
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", "[not json"), (1, 2, "user", None)], "conv_id long, turn long, role string, c string")
    r = chat.format_conversations(df.withColumn("p", chat.parse_parts(F.col("c"))), "p").first()
    assert "see <|image_1|><|audio_2|><|document_3|><|image_4|> end <\\|x|><|im_end|>" in r["formatted"]
    assert [(a["turn"], a["part"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 1, "s3:i", 3), (0, 2, "a", 50), (0, 3, "d", 1800), (0, 4, None, 1)]
    assert r["attachment_tokens"] == 1854


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(8)
    text = lambda n: " ".join("w%d" % rng.randrange(4000) for _ in range(n))
    items = [(k, text(20)) for k in range(5)]
    base = [text(80) for _ in range(90)]
    rows = [(k, t) for k, t in enumerate(base)]
    near = {100 + k: base[k].replace(base[k].split()[40], "changed", 1) for k in range(8)}
    leaks = {200 + k: text(30) + " " + items[k][1] + " " + text(30) for k in range(5)}
    toxic = {300 + k: text(40) + f" you loser moron {k} " + text(20) for k in range(40)}
    rows += [*near.items(), *leaks.items(), *toxic.items(), (400, base[3]), (401, None), (402, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", 0) for i, t in rows], SCHEMA)
    spark.createDataFrame([(i, 0, int(300 <= i < 400)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left, ids = docs, []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, left, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        left = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append(None if k == 4 else [r["doc_id"] for r in left.collect()])
    assert sorted(ids[0]) == sorted(i for i, _ in rows if not 300 <= i < 400)
    assert sorted(ids[1]) == sorted([*range(90), *leaks, 401, 402])
    assert sorted(ids[2]) == sorted([*range(90), 401, 402])
    assert set(ids[3]) <= set(ids[2]) and len(ids[3]) > 60
    packed = Counter(d for r in left.collect() for d, p in zip(r["doc_ids"], r["parts"]) if p == 0)
    assert packed == Counter(ids[3])
    run = P.run(spark, str(tmp_path)).collect()
    assert Counter(d for r in run for d, p in zip(r["doc_ids"], r["parts"]) if p == 0) == packed
