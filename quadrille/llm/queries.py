"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, embedding_dedup, exact_dedup, hard_negatives, language_id, packing, periodic_runs, sharding, simhash, substring_dedup, token_output, warc
from .common import read

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    """The tokenizer file, as the installed package has it on the driver and on executors."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).alias("conv_id"), F.lit(k).alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text")) for k, r in enumerate(("user", "assistant"))))).alias("t")).select("t.*")
    out = chat_format.format_conversations(turns.unionByName(extra.select(*(F.col(c).cast(turns.schema[c].dataType) for c in turns.columns))))
    read_back = out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(read(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_digest("ids").alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.predict(docs.select("doc_id", "text", language_id.held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), unit="sentence")
    span = F.transform("removed", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string")))
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), F.array_join(span, ",").alias("removed"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.new_path(spark)
    token_output.write(read(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_output.read_checks(spark, path).select("id", "start", F.col("ids.n").alias("n_tokens"), F.col("ids.crc32").alias("ids_crc32")).withColumnRenamed("id", "doc_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(read(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    told = periodic_runs.find_runs(docs).withColumn("best", periodic_runs.longest_by_periods(F.col("runs")))
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = read(spark, sf_dir, "pages"), warc.new_path(spark)
    warc.write(pages, path)
    facts = warc.payload_facts(warc.read(spark, path))
    return facts.withColumns({c: F.col(c).cast(pages.schema["page_id"].dataType) for c in ("page_id", "refers_to")})


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    finite = F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))  # noqa: PLR0124
    rows = rows.where(finite).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows.withColumn("v", F.transform("v", lambda x: F.floor(x * 256))), F.col("id") % 100 == 0, vec_col="v")


FOLD = f"translate(coalesce(text, ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    escaped = lambda c: rf"regexp_replace(coalesce({c}, ''), '([<\[])(\\*)(\|start\|>|\|sep\|>|\|join\|>|\|end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')"
    return {
        "op1_embedding_dedup": """
            with recursive v as (
                select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
            ), ok as (
                select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
                and len(list_filter(e, lambda x: x <> 0)) > 0
            ), link as (
                select a.vec_id as x, b.vec_id as y from ok a join ok b
                on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98
            ), reach as (
                select vec_id as x, vec_id as y from v union select r.x, l.y from reach r join link l on r.y = l.x
            ), comp as (select x, min(y) as c from reach group by x),
            n as (select x, count(*) as k from link group by x)
            select vec_id, coalesce(k, 0) as n_links, c as component_id, vec_id = c as kept
            from v join comp on comp.x = vec_id left join n on n.x = vec_id""",
        "op2_chat_format": rf"""
            with t as (
                select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
            ), e as (
                select *, {escaped('role')} as r, {escaped('text')} as x,
                    lag(role) over (partition by conv_id order by turn, role, text) is distinct from role as first
                from t
            )
            select conv_id, count(*) as n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
                cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
                sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
                cast(sum(length(x) + case when first then 9 + length(r) + 7 + 7 else 8 end) as bigint) as formatted_chars
            from e group by conv_id""",
        "op6_substring_dedup": r"""
            with u as (
                select doc_id, text, unnest(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+')) as unit,
                    generate_subscripts(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+'), 1) as k
                from documents
            ), p as (
                select *, sum(length(unit)) over (partition by doc_id order by k) as stop,
                    trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) as norm
                from u
            ), r as (
                select *, len(string_split(norm, ' ')) >= 5 and row_number() over (partition by norm order by doc_id, k) > 1 as again from p
            ), g as (
                select doc_id, string_agg(unit, '' order by k) filter (where not again) as kept, count(*) filter (where again) as n,
                    string_agg(cast(stop - length(unit) as bigint) || '-' || cast(stop as bigint), ',' order by k) filter (where again) as spans
                from r group by doc_id
            )
            select doc_id, case when g.doc_id is null then text else coalesce(kept, '') end as text, coalesce(n, 0) as n_removed, coalesce(spans, '') as removed
            from documents left join g using (doc_id)""",
        "op12_warc": """
            with p as (
                select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h,
                    row_number() over w as k, first_value(page_id) over w as first
                from pages window w as (partition by coalesce(html, '') order by page_id desc nulls last)
            )
            select page_id, payload_bytes, case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then first end as refers_to,
                array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    1 + cast(((cast('0x' || substr(h, 1 + 5 * (i // 4), 5) as integer) >> (5 * (3 - i % 4))) & 31) as integer), 1)), '') as payload_digest
            from p""",
        "op13_hard_negatives": """
            with v as (
                select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
                from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
            ), p as (
                select * from (
                    select a.vec_id as a, a.label, a.e, b.vec_id as p, cast(list_inner_product(a.e, b.e) as bigint) as ps,
                        row_number() over (partition by a.vec_id order by list_inner_product(a.e, b.e) desc, b.vec_id) as k
                    from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0
                ) where k <= 5
            ), n as (
                select a, p, ps, vec_id, cast(list_inner_product(p.e, v.e) as bigint) as ns from p join v on p.label <> v.label
            ), r as (
                select *, row_number() over (partition by a, p order by ns desc, vec_id) as rank from n where 30 * ps <= 100 * ns and 100 * ns <= 90 * ps
            )
            select a as anchor_id, p as positive_id, cast(rank as integer) as rank, vec_id as negative_id, ps as positive_score, ns as negative_score from r where rank <= 10""",
        "op10_exact_dedup": f"""
            with t as (select doc_id, sha256({FOLD}) as text_sha256 from documents)
            select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
            from t window g as (partition by text_sha256)""",
    }
