"""DuckDB SQL for the registered queries: an independent statement of each result.

The SQL uses window functions where the Spark side uses the two-level prefix sum
and joins, so the two are different formulations of one definition. Arrays are
compared through ``md5`` of their space-joined text; doubles that pass through
``ln``/``exp`` or unordered float sums are rounded to 6 places on both sides.
"""

from __future__ import annotations

from tessera import config as C
from tessera.functions.text import PY_WHITESPACE
from tessera.functions.tokens import TOKEN_PATTERN

# RE2 spellings of the Java patterns in tessera.functions.text.
BREAK_RE2 = "\\r\\n|[\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"
BREAK_CHAR_RE2 = "[\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"
NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ids_sql(text: str) -> str:
    m = C.VOCAB_SIZE - 1
    return (
        f"list_transform(regexp_extract_all({text}, {q(TOKEN_PATTERN)}), "
        f"lambda w: ((('0x' || substr(md5(w), 1, 8))::BIGINT % {m}) + 1)::INTEGER)"
    )


def count_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, {q(TOKEN_PATTERN)}))"


def lines_sql(t: str) -> str:
    return (
        f"(len(regexp_extract_all({t}, {q(BREAK_RE2)})) + CASE WHEN length({t}) > 0 AND NOT "
        f"regexp_matches(right({t}, 1), {q(BREAK_CHAR_RE2)}) THEN 1 ELSE 0 END)"
    )


def alnum_sql(t: str) -> str:
    return f"(length(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length({t}))"


def strip_sql(t: str) -> str:
    return f"trim({t}, {q(PY_WHITESPACE)})"


def marker_sql(t: str) -> str:
    h = f"lower(substr({t}, 1, {C.HEADER_CHARS}))"
    return "(" + " OR ".join(f"contains({h}, {q(m)})" for m in C.AUTOGEN_MARKERS) + ")"


def structure_sql(t: str) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(m)})" for m in C.STRUCTURE_MARKERS) + ")"


def reason_sql(t: str = "text", profile: str = "prose") -> str:
    n = f"length({t})"
    parts = [
        f"WHEN {t} IS NULL OR {n} < {C.MIN_CHARS} OR {n} > {C.MAX_CHARS} THEN 'chars'",
        f"WHEN {lines_sql(t)} < {C.MIN_LINES} THEN 'lines'",
        f"WHEN NOT ({n} / greatest({lines_sql(t)}, 1) BETWEEN {C.MIN_AVG_LINE} AND {C.MAX_AVG_LINE}) THEN 'avg_line'",
        f"WHEN {alnum_sql(t)} < {C.MIN_ALNUM_RATIO} THEN 'alnum'",
        f"WHEN {marker_sql(t)} THEN 'autogen'",
    ]
    if profile == "code":
        parts.append(f"WHEN NOT {structure_sql(t)} THEN 'structure'")
    parts.append(f"WHEN strpos({t}, chr(0)) > 0 THEN 'nul'")
    return "CASE " + " ".join(parts) + " ELSE 'keep' END"


def arr_md5(a: str) -> str:
    return f"md5(array_to_string({a}, ' '))"


KEPT = f"kept AS (SELECT doc_id, text FROM documents WHERE {reason_sql()} = 'keep')"
TOKENS = f"tok AS (SELECT doc_id, list_append({ids_sql('text')}, 0) AS ids FROM kept)"
STARTS = (
    "st AS (SELECT doc_id, ids, len(ids) AS n, "
    "SUM(len(ids)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - len(ids) AS start FROM tok)"
)


def chunks_cte(block: int = C.BLOCK, limit_chunks: int | None = None) -> str:
    lim = f" AND gpos < {limit_chunks * block}" if limit_chunks is not None else ""
    return (
        "flat AS (SELECT start + unnest(generate_series(0, n - 1)) AS gpos, unnest(ids) AS id FROM st), "
        f"ch AS (SELECT gpos // {block} AS chunk_id, string_agg(id::VARCHAR, ' ' ORDER BY gpos) AS ids_text, "
        f"count(*) AS n_tokens, sum(id) AS ids_sum FROM flat WHERE TRUE{lim} GROUP BY 1 HAVING count(*) = {block})"
    )


def seeded(keys: list[str], seed: int) -> str:
    return "md5(concat_ws(':', " + ", ".join([q(str(seed))] + [f"CAST({k} AS VARCHAR)" for k in keys]) + "))"


def corpus_split_cte(fraction: float = C.VAL_FRACTION) -> str:
    return (
        f"rk AS (SELECT chunk_id, ids_text, row_number() OVER (ORDER BY {seeded(['chunk_id'], C.DATA_SEED)}, chunk_id) - 1 AS r, "
        "count(*) OVER () AS n FROM ch), "
        f"sp AS (SELECT *, CASE WHEN r >= n - greatest(1, floor(n * {fraction}::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM rk)"
    )


INSTR = (
    "inst AS (SELECT conv_id, turn, text AS instruction, CASE WHEN prev_role = 'system' THEN prev_text END AS input, "
    "next_text AS output FROM (SELECT conv_id, turn, role, text, "
    "lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, lag(role) OVER w AS prev_role, "
    "lag(text) OVER w AS prev_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "
    "WHERE role = 'user' AND next_role = 'assistant')"
)


def format_sql(ins: str = "instruction", inp: str = "input", out: str = "output") -> str:
    blank = f"({inp} IS NULL OR length({strip_sql(inp)}) = 0)"
    input_part = f"CASE WHEN {blank} THEN '' ELSE '### Input:' || {NL} || {strip_sql(inp)} || {NL} || {NL} END"
    return (
        f"('### Instruction:' || {NL} || {strip_sql(ins)} || {NL} || {NL} || {input_part} || "
        f"'### Response:' || {NL} || {strip_sql(out)})"
    )


def sft_split_cte(seed: int = C.SFT_SEED, fraction: float = C.SFT_VAL_FRACTION) -> str:
    return (
        f"ssp AS (SELECT *, CASE WHEN r >= n - ceil(n * {fraction}::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM "
        f"(SELECT *, row_number() OVER (ORDER BY {seeded(['conv_id', 'turn'], seed)}, conv_id, turn) - 1 AS r, "
        "count(*) OVER () AS n FROM inst))"
    )


def samples_cte(max_len: int = C.SFT_MAX_SEQ_LEN, min_tokens: int = C.SFT_MIN_TOKENS, src: str = "ssp") -> str:
    marker = f"strpos(text, '### Response:' || {NL})"
    prefix = f"substr(text, 1, {marker} - 1 + {len(C.RESPONSE_MARKER)})"
    return (
        f"fmt AS (SELECT *, {format_sql()} AS text FROM {src}), "
        f"tk AS (SELECT *, list_append({ids_sql('text')}, 0) AS full_ids, {marker} AS marker, "
        f"{count_sql(prefix)} AS prefix_n FROM fmt), "
        f"tr AS (SELECT *, full_ids[1:{max_len}] AS input_ids, len(full_ids) > {max_len} AS truncated FROM tk), "
        "pl AS (SELECT *, len(input_ids) AS n_tokens, least(prefix_n, len(input_ids)) AS prompt_len FROM tr), "
        "lb AS (SELECT *, list_concat(list_transform(range(prompt_len), lambda x: -100), input_ids[prompt_len + 1:]) AS labels, "
        f"CASE WHEN text IS NULL THEN 'null_field' WHEN marker = 0 THEN 'no_marker' WHEN n_tokens < {min_tokens} "
        "THEN 'too_short' ELSE 'keep' END AS reason FROM pl)"
    )


def n_supervised_sql(labels: str = "labels") -> str:
    return f"len(list_filter({labels}[2:], lambda x: x <> -100))"


EVENTS_MICRO = (
    "m AS (SELECT user_id AS run_id, value, CAST(value AS DECIMAL(12,2)) * CAST(0.01 AS DECIMAL(3,2)) AS loss, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS micro_idx FROM events)"
)


def steps_cte(accum: int, eff_batch: int, context: int) -> str:
    return (
        f"s AS (SELECT run_id, step, CAST(sl AS DOUBLE) / {float(accum)} AS train_loss, grad_norm, "
        f"step * {eff_batch * context} AS tokens_seen FROM (SELECT run_id, micro_idx // {accum} + 1 AS step, "
        f"sum(loss) AS sl, count(*) AS c, arg_max(value, micro_idx) AS grad_norm FROM m GROUP BY 1, 2) WHERE c = {accum})"
    )
