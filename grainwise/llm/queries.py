"""One query per operator, over its whole benchmark table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_codes, bpe, conversation_trie, embedding_dedup, language, minhash, packing, quality, secrets, sentencepieces, token_counts, topk, warc
from .shared import held_out, new_folder, ship_package

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    machine = quality.learn(docs, _table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality.score_quality(docs, machine)
    return scored.select("doc_id", held_out(1, 3).alias("held_out"), "score", "predicted")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, split_added=True)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan_secrets(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    judged = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return judged.select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    records = warc.read_warc(spark, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.codes_of(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_minhash_near_dedup,
        op2_token_counts,
        op3_quality_classifier,
        op4_byte_bpe,
        op5_packing,
        op6_secret_scan,
        op7_language_id,
        op8_exact_topk,
        op9_embedding_near_dedup,
        op10_warc,
        op11_vector_codes,
        op12_conversation_trie,
        op13_sentencepiece,
    )
}


def _vector_codes_sql(rounds: int) -> str:
    """Plain k-means of four parts, round by round; whole numbers stand in doubles, which hold them."""
    steps = ""
    for r in range(rounds + 1):
        steps += f"""
        near{r} as materialized (
            select vec_id, part, arg_min({{'entry': entry, 'd': d}}, (d, entry)) as best
            from (select p.vec_id, p.part, e.entry, p.x2 + e.e2 - 2 * list_inner_product(p.v, e.v) as d
                from parts p join book{r} e on e.part = p.part)
            group by vec_id, part
        ),"""
        if r < rounds:
            steps += f"""
        means{r} as (
            select part, entry, list(m order by place) as v from (
                select n.part, n.best.entry as entry, place, floor(sum(p.v[place]) / count(*)) as m
                from near{r} n join parts p on p.vec_id = n.vec_id and p.part = n.part, (select unnest(range(1, width + 1)) as place from shape)
                group by all
            ) group by part, entry
        ),
        book{r + 1} as materialized (
            select part, entry, v, list_inner_product(v, v) as e2
            from (select b.part, b.entry, coalesce(m.v, b.v) as v from book{r} b left join means{r} m on m.part = b.part and m.entry = b.entry)
        ),"""
    return f"""
        with usable as (
            select vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        shape as (select max(len(v)) // 4 as width from usable),
        parts as materialized (
            select vec_id, part, v, list_inner_product(v, v) as x2
            from (select vec_id, part, v[part * width + 1 : (part + 1) * width] as v from usable, shape, (select unnest(range(0, 4)) as part))
        ),
        book0 as materialized (
            select part, entry, v, x2 as e2 from parts
            join (select vec_id, row_number() over (order by vec_id) - 1 as entry from usable order by vec_id limit 256) using (vec_id)
        ),{steps}
        books as (
            select sha256(string_agg(cast(cast(v[place] as bigint) as varchar), ',' order by part, entry, place)) as codebooks_sha256
            from book{rounds}, (select unnest(range(1, width + 1)) as place from shape)
        ),
        coded as (
            select vec_id, string_agg(printf('%02x', best.entry), '' order by part) as code, cast(sum(best.d) as bigint) as error
            from near{rounds} group by vec_id
        )
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
        from coded join usable using (vec_id), books
    """


def _secrets_sql() -> str:
    """Spans by splitting texts at the matches of each kind; entropy counted anew in every window."""
    kinds = (
        # Letters in either case, spelled out: a case-insensitive match would take in letters beyond ASCII.
        ("assign", "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token"))
         + """|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""".replace("\\\\", "\\"), 2, "length(part) >= 12"),
        ("access", "AKIA[A-Z0-9]+", 0, "length(whole) >= 18"),
        ("hex", "[0-9a-f]{16,}", 0, "true"),
        ("entropy", "[A-Za-z0-9+/_=-]{20,}", 0, """
            regexp_matches(whole, '[0-9]') and regexp_matches(whole, '[A-Za-z]')
            and not regexp_matches(whole, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^(?i)sha(256|384|512)-')
            and len(list_filter(string_split_regex(whole, '(?i)example|sample|dummy|placeholder|changeme|redacted|x{5,}|abcdefghij|0123456789|1234567890'),
                lambda p: length(p) >= 20 and regexp_matches(p, '[0-9]') and regexp_matches(p, '[A-Za-z]')
                    and round(list_max(list_transform(range(1, length(p) - 18), lambda s: log2(20) - list_sum(list_transform(
                        list_distinct(string_split(substr(p, s, 20), '')),
                        lambda c: (20 - length(replace(substr(p, s, 20), c, ''))) * log2(20 - length(replace(substr(p, s, 20), c, ''))))) / 20)), 9)
                    >= case when regexp_matches(p, '^[0-9a-f-]+$|^[0-9A-F-]+$') then 3.0e0
                        when regexp_matches(p, '^[0-9a-z]+$|^[0-9A-Z]+$') then 3.4e0 else 3.7e0 end)) > 0"""),
    )
    parts = "\nunion all ".join(
        f"""select row, {number} as kind, '{name}' as name, whole, start, start + length(whole) as stop from (
            select row, wholes[i] as whole, parts[i] as part,
                coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
                    + coalesce(list_sum(list_transform(wholes[1:i - 1], lambda x: length(x))), 0) as start
            from (select row, regexp_extract_all(text, '{pattern}') as wholes, regexp_extract_all(text, '{pattern}', {group}) as parts,
                    string_split_regex(text, '{pattern}') as gaps, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) as i
                from docs where regexp_matches(text, '{pattern}'))
        ) where {kept}"""
        for number, (name, pattern, group, kept) in enumerate(kinds)
    )
    listed = "string_agg(name || ':' || start || ':' || stop, ',' order by start, kind)"
    return f"""
        with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
        spans as ({parts}),
        summed as (
            select row, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access,
                count(*) filter (where kind = 2) as n_hex, count(*) filter (where kind = 3) as n_entropy,
                {listed.replace(")", ") filter (where kind < 3)")} as base, {listed} as listed
            from spans group by row
        )
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
            sha256(coalesce(base, '')) as base_sha256, coalesce(listed, '') as spans, coalesce(n_entropy, 0) as n_entropy
        from docs left join summed on summed.row = docs.row
    """


ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
        with recursive words as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
            from documents
        ),
        sets as (
            select doc_id, case when len(w) = 0 then []
                when len(w) < 5 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
            from words
        ),
        single as (select doc_id, unnest(s) as shingle from sets),
        shared as (
            select x.doc_id as a, y.doc_id as b, count(*) as n_both
            from single x join single y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by all
        ),
        links as (
            select a, b from shared join sets p on p.doc_id = a join sets q on q.doc_id = b
            where 100 * n_both >= 75 * (len(p.s) + len(q.s) - n_both)
        ),
        reach as (
            select doc_id as id, doc_id as seen from sets
            union
            select reach.id, links.b from reach join links on links.a = reach.seen
        ),
        smallest as (select id, min(seen) as component_id from reach group by id)
        select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept
        from sets join smallest on smallest.id = doc_id
    """,
    "op6_secret_scan": _secrets_sql(),
    "op8_exact_topk": """
        with usable as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        scored as (
            select q.vec_id as query_id, c.vec_id,
                cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
            from usable q join usable c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
            where q.vec_id % 100 = 0
        ),
        ranked as (
            select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank
            from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 10
    """,
    "op9_embedding_near_dedup": """
        with recursive usable as (
            select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v
            from embeddings
            where embedding is not null and label is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links as (
            select x.vec_id as a, y.vec_id as b
            from usable x join usable y on x.label = y.label and x.vec_id <> y.vec_id and len(x.v) = len(y.v)
            where list_cosine_similarity(x.v, y.v) >= 0.93
        ),
        reach as (
            select vec_id as id, vec_id as seen from embeddings
            union
            select reach.id, links.b from reach join links on links.a = reach.seen
        ),
        smallest as (select id, min(seen) as component_id from reach group by id),
        degree as (select a, count(*) as n from links group by a)
        select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
        from embeddings join smallest on smallest.id = vec_id left join degree on degree.a = vec_id
    """,
    "op10_warc": """
        with payloads as (
            select page_id, encode(coalesce(html, '')) as payload from pages
        ),
        digests as (
            select page_id, octet_length(payload) as n, sha1(payload) as h,
                min(page_id) over (partition by payload) as first
            from payloads
        )
        select page_id, cast(n as bigint) as payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as integer) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '')
                as payload_digest,
            case when page_id = first then 'response' else 'revisit' end as record_type,
            case when page_id = first then null else first end as refers_to
        from digests
    """,
    "op11_vector_codes": _vector_codes_sql(4),
    "op12_conversation_trie": """
        with recursive crc_table as (
            select list(x order by byte) as t from (
                select byte, list_reduce(list_prepend(byte, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                    lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as x
                from (select unnest(range(0, 256)) as byte)
            )
        ),
        turns as (
            select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                row_number() over (partition by conv_id order by turn nulls first, role) as pos
            from conversations where conv_id is not null
        ),
        convs as (
            select conv_id, conv_id - conv_id % 100 as base,
                xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''),
                        lambda c: cast(ord(c) as bigint))),
                    lambda x, c: xor(x >> 8, t[cast(xor(x, c) & 255 as integer) + 1])), 4294967295) % 6 as h
            from (select distinct conv_id from turns), crc_table
        ),
        path as (
            select c.conv_id, 0 as own, p.pos, p.role, p.text from convs c join turns p on p.conv_id = c.base and p.pos <= c.h
            union all
            select c.conv_id, 1, p.pos, p.role, p.text from convs c join turns p on p.conv_id = c.conv_id and p.pos > c.h
        ),
        steps as (
            select conv_id, row_number() over (partition by conv_id order by own, pos) as depth,
                sha256(length(role) || ':' || role || text) as step, length(text) as n
            from path
        ),
        keys as (
            select c.conv_id, 0 as depth, '' as key, 0 as n from convs c
            union all
            select k.conv_id, s.depth, sha256(k.key || s.step), s.n from keys k join steps s on s.conv_id = k.conv_id and s.depth = k.depth + 1
        ),
        ended as (select conv_id, max(depth) as depth from keys group by conv_id),
        nodes as (
            select key, depth, min(conv_id) as name, count(*) as n_convs, any_value(n) as n,
                (count(*) - 1) * any_value(n) as saves,
                sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
            from (select k.*, k.depth = e.depth as ends from keys k join ended e using (conv_id)) group by key, depth
        ),
        parents as (
            select distinct k.key, k.depth, u.key as above from keys k join keys u on u.conv_id = k.conv_id and u.depth = k.depth - 1
        ),
        below as (select above, count(*) as n_children from parents group by above),
        subtree as (
            select u.key, sum(v.saves) as saved_tokens, count(*) filter (where b.above is null) as n_leaves
            from nodes v join keys k on k.conv_id = v.name and k.depth <= v.depth
            join keys kv on kv.conv_id = v.name and kv.depth = v.depth and kv.key = v.key
            join nodes u on u.key = k.key and u.depth = k.depth
            left join below b on b.above = v.key
            group by u.key
        )
        select n.name as conv_id, cast(n.depth as bigint) as depth, p.name as parent_conv_id, n.n_convs,
            coalesce(b.n_children, 0) as n_children, s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, n.ends_sha256
        from nodes n left join parents q on q.key = n.key left join nodes p on p.key = q.above
        left join below b on b.above = n.key join subtree s on s.key = n.key
    """,
}
