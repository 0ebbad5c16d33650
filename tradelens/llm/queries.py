"""The registered queries: each applies an operator to its whole table and derives the digest columns."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, held_out, operator, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import kept_lines, with_bitmaps

    @operator
    def line_dedup(docs: DataFrame) -> DataFrame:
        return with_bitmaps(docs).mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")

    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches):
        for b in blocks(batches):
            n, gone, sha = [], [], []
            for text, bitmap in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = kept_lines(text, bitmap)
                n.append((text or "").count("\n") + 1)
                gone.append(n[-1] - len(lines))
                sha.append(hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n), pa.array(gone), pa.array(sha)], schema=schema)

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs.withColumn("held_out", held_out("doc_id", 3, 1)), train(docs), ("doc_id", "held_out"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80).drop("row", "component")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gru_lm import score

    return score(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import kept_bytes, with_spans

    @operator
    def repeats(docs: DataFrame) -> DataFrame:
        return with_spans(docs).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches):
        for b in blocks(batches):
            texts = [x or b"" for x in b.column(1).cast(pa.large_binary()).to_pylist()]
            spans = b.column(2).to_pylist()
            kept = [kept_bytes(x, s) for x, s in zip(texts, spans, strict=True)]
            n, left = ([len(x) for x in y] for y in (texts, kept))
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            cols = [pa.array(n), pa.array([x - y for x, y in zip(n, left, strict=True)]), pa.array([len(s or ()) // 2 for s in spans]), pa.array(sha)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols], schema=schema)

    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs, word_list

    def made_periodic(batches):
        """The contract's texts: of every document whose checksum is divisible by 10, words from one on repeat with a period."""
        for b in blocks(batches):
            out = []
            for d, x in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                h = zlib.crc32(b"" if d is None else str(d).encode())
                words, g = word_list(x) if h % 10 == 0 else [], h // 10
                if words:
                    n = len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    x = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])
                out.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.large_binary()).cast(pa.large_string())], names=["doc_id", "text"])

    schema = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def digest(batches):
        for b in blocks(batches):
            rows = []
            for d, found, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                best = min(found, key=lambda r: (-r["length"], r["start"], r["period"]), default=None)
                top = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
                told = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in found)
                rows.append((d, len(found), *top, *(hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (told, text))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    @operator
    def runs(docs: DataFrame) -> DataFrame:
        made = docs.mapInArrow(made_periodic, "doc_id long, text string")
        return periodic_runs(made).mapInArrow(digest, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

    return runs(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .drake import clusters

    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string"))), 256)
    return clusters(table(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_nearest, op3_sentencepiece, op4_token_output, op5_line_dedup, op6_language_id, op7_near_dup, op8_lm_scoring, op9_quality, op10_packing, op11_repeats, op12_runs, op13_clusters)}

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = f"'{_AZ}', '{_AZ.lower()}'"

#: DuckDB SQL of the operators that it can express over whole tables; tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": rf"""with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, i, line, translate(regexp_replace(line, '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g'), {_FOLD}) as k
 from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d)),
g as (select k, max(doc_id) as last from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (where doc_id < last) as n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by i) filter (where last is null or doc_id = last), '')) as kept_sha256
from l left join g using (k) group by doc_id""",
    "op7_near_dup": rf"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_FOLD}), '[\x09-\x0D ]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
c as (select doc_id, len(s) as n, s from s),
cls as (select min(doc_id) as rep, n, list_sort(s) as s from c where n > 0 group by n, list_sort(s)),
mem as (select c.doc_id, cls.rep from c join cls on c.n = cls.n and list_sort(c.s) = cls.s),
u as (select rep, n, hash(unnest(s)) as h from cls),
p as (select a.rep as a, b.rep as b from u a join u b on a.h = b.h and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e as (select a, b from p union select b, a from p union select rep, rep from cls),
r as (select a as x, b as y from e union select r.x, e.b from r join e on r.y = e.a),
m as (select x, min(y) as m from r group by x)
select c.doc_id, c.n as n_shingles, coalesce(m.m, c.doc_id) as component_id, coalesce(m.m, c.doc_id) = c.doc_id as kept from c left join mem using (doc_id) left join m on m.x = mem.rep""",
}

#: Windows of 200 bytes as 400 hexadecimal digits; a byte goes if one of the 200 windows that hold it stands twice.
ORACLE_SQL["op11_repeats"] = """with d as (select doc_id, row_number() over () as r, hex(encode(coalesce(text, ''))) as x from documents),
p as (select r, c, substr(x, 512 * c + 1, 910) as y from (select r, x, unnest(range((length(x) + 511) // 512)) as c from d)),
b as (select r, 256 * c + j as i, substr(y, 2 * j + 1, 2) as byte, case when 2 * j + 400 <= length(y) then md5(substr(y, 2 * j + 1, 400)) end as w from (select r, c, y, unnest(range(least(256, length(y) // 2))) as j from p)),
k as (select w from b where w is not null group by w having count(*) > 1),
t as (select r, i, byte, max(case when k.w is not null then i end) over (partition by r order by i) as last from b left join k using (w)),
g as (select r, i, byte, last is not null and i < last + 200 as gone from t),
e as (select *, gone and not coalesce(lag(gone) over (partition by r order by i), false) as opens from g),
s as (select r, count(*) as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_spans, sha256(unhex(coalesce(string_agg(byte, '' order by i) filter (where not gone), ''))) as kept_sha256 from e group by r)
select doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, coalesce(kept_sha256, sha256('')) as kept_sha256 from d left join s using (r)"""


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    near = "select v.r, v.vec_id, v.x, min({'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'c': c.c}) as n from v, c%d as c group by v.r, v.vec_id, v.x"
    parts = [
        "e as (select vec_id, list_transform(embedding, lambda a: 64 * a::double) as y from embeddings where len(embedding) = 64)",
        "v as (select row_number() over () as r, vec_id, list_transform(y, lambda a: floor(a)::bigint) as x from e where len(list_filter(y, lambda a: a is not null and isfinite(a))) = 64)",
        f"c0 as (select c, x from (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), x)::int - 1 as c, x from v) where c < {k})",
    ]
    for i in range(rounds):
        parts.append(f"a{i} as materialized ({near % i})")
        parts.append(f"m{i} as (select c, list(floor(t / k)::bigint order by j) as x from (select n.c as c, j, sum(x[j]) as t, count(*) as k from a{i}, unnest(range(1, 65)) as u(j) group by n.c, j) group by c)")
        parts.append(f"c{i + 1} as materialized (select c{i}.c, coalesce(m{i}.x, c{i}.x) as x from c{i} left join m{i} using (c))")
    parts.append(f"z as materialized ({near % rounds})")
    return (
        "with " + ",\n".join(parts) + "\nselect vec_id, n.c as cluster, n.d as distance, sum(n.d) over (partition by n.c)::bigint as cluster_inertia, sum(n.d) over ()::bigint as inertia,"
        f" sha256(list_aggregate(f.x, 'string_agg', ',')) as centroid_sha256 from z join c{rounds} as f on f.c = n.c"
    )


ORACLE_SQL["op13_clusters"] = _clusters_sql()
