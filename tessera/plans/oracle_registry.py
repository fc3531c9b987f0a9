"""DuckDB SQL per registered query (same keys and column names as ``queries.QUERIES``).

Whether a source text compiles is known here by its construction from ``documents``.
"""

from __future__ import annotations

import math

from tessera import config as C
from tessera.plans import queries as Q
from tessera.plans.oracles import (
    EVENTS_MICRO,
    INSTR,
    KEPT,
    NL,
    STARTS,
    TOKENS,
    alnum_sql,
    chunks_cte,
    corpus_split_cte,
    count_sql,
    format_sql,
    ids_sql,
    lines_sql,
    marker_sql,
    n_supervised_sql,
    q,
    reason_sql,
    samples_cte,
    seeded,
    sft_split_cte,
    steps_cte,
    strip_sql,
    structure_sql,
)

R = reason_sql("text", "prose")
PACKED = f"WITH {KEPT}, {TOKENS}, {STARTS}, {chunks_cte()}"
SPLIT = f"{PACKED}, {corpus_split_cte()}"


def _quality_signals() -> str:
    return (
        "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(nl AS INTEGER) AS n_lines, "
        "length(text) / greatest(nl, 1) AS avg_line, ar AS alnum_ratio, mk AS has_autogen_marker, "
        "sc AS has_structure, strpos(text, chr(0)) > 0 AS has_nul FROM ("
        f"SELECT doc_id, text, {lines_sql('text')} AS nl, {alnum_sql('text')} AS ar, {marker_sql('text')} AS mk, "
        f"{structure_sql('text')} AS sc FROM documents)"
    )


def _manifest_ctes(cfg=Q.MANIFEST) -> str:
    bs, a = cfg.batch_size, cfg.grad_accum
    return (
        f"{SPLIT}, tr AS (SELECT chunk_id FROM sp WHERE split = 'train'), "
        f"cnt AS (SELECT count(*) AS n, count(*) // {bs} AS nb FROM tr), "
        f"ep AS (SELECT unnest(generate_series(0, CAST(ceil({cfg.max_steps * a} / nb) AS BIGINT) - 1)) AS epoch FROM cnt), "
        f"o AS (SELECT chunk_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY {seeded(['epoch', 'chunk_id'], cfg.seed)}, "
        "chunk_id) - 1 AS pos FROM tr, ep), "
        f"b AS (SELECT o.chunk_id, o.epoch, o.pos, o.pos // {bs} AS micro, o.epoch * cnt.nb + o.pos // {bs} AS global_micro, "
        f"cnt.nb FROM o, cnt WHERE o.pos < cnt.nb * {bs}), "
        f"mf AS (SELECT *, global_micro // {a} + 1 AS step FROM b WHERE global_micro // {a} + 1 <= {cfg.max_steps})"
    )


def _sft_samples(src: str, cfg=Q.SFT) -> str:
    return samples_cte(cfg.max_len, cfg.min_tokens, src)


def _sample_report(cfg) -> str:
    return (
        f"WITH {INSTR}, {_sft_samples('inst', cfg)} SELECT conv_id, turn, CAST(n_tokens AS INTEGER) AS n_tokens, "
        "CAST(prompt_len AS INTEGER) AS prompt_len, truncated, reason, md5(array_to_string(input_ids, ' ')) AS ids_md5, "
        "md5(array_to_string(labels, ' ')) AS labels_md5 FROM lb"
    )


NEXT_USER = (
    "nx AS (SELECT conv_id, turn, next_user FROM (SELECT conv_id, turn, lead(role, 2) OVER w AS next_role, "
    "lead(text, 2) OVER w AS next_user FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "
    "WHERE next_role = 'user')"
)
def _sft_summary(cfg) -> str:
    return (
        f"WITH {INSTR}, {sft_split_cte()}, {_sft_samples('ssp', cfg)} SELECT split, "
        "count(*) FILTER (WHERE reason = 'keep') AS loaded, count(*) FILTER (WHERE reason <> 'keep') AS skipped, "
        "count(*) FILTER (WHERE reason = 'no_marker') AS skipped_no_marker, "
        "count(*) FILTER (WHERE reason = 'too_short') AS skipped_too_short, "
        "count(*) FILTER (WHERE reason = 'null_field') AS skipped_null_field, "
        "count(*) FILTER (WHERE reason = 'keep' AND truncated) AS truncated, "
        "count(*) FILTER (WHERE reason = 'keep' AND prompt_len >= n_tokens) AS fully_masked, "
        "CAST(coalesce(sum(n_tokens) FILTER (WHERE reason = 'keep'), 0) AS BIGINT) AS tokens, "
        f"CAST(coalesce(sum({n_supervised_sql()}) FILTER (WHERE reason = 'keep'), 0) AS BIGINT) AS supervised_tokens "
        "FROM lb GROUP BY split"
    )


BEFORE_CUT = "split_part(rest, '### Instruction:', 1)"


def _completions() -> str:
    marker = f"strpos(f.text, '### Response:' || {NL})"
    return (
        f"{INSTR}, fmt AS (SELECT conv_id, turn, input, {format_sql()} AS text FROM inst), "
        f"{NEXT_USER}, "
        f"c AS (SELECT f.conv_id, f.turn, f.input, substr(f.text, 1, {marker} - 1 + {len(C.RESPONSE_MARKER)}) AS prompt, "
        f"f.text || CASE WHEN nx.next_user IS NULL THEN '' ELSE {NL} || {NL} || '### Instruction:' || {NL} || nx.next_user END "
        "AS text FROM fmt f LEFT JOIN nx ON f.conv_id = nx.conv_id AND f.turn = nx.turn), "
        "t AS (SELECT *, substr(text, length(prompt) + 1) AS rest FROM c), "
        "tc AS (SELECT *, CASE WHEN strpos(rest, '### Instruction:') > 0 THEN substr(text, 1, length(prompt)) || "
        f"{strip_sql(BEFORE_CUT)} ELSE text END AS trimmed FROM t)"
    )


def _sft_manifest(cfg=Q.SFT) -> str:
    bs, a = cfg.batch_size, cfg.grad_accum
    return (
        f"WITH {INSTR}, {sft_split_cte()}, {_sft_samples('ssp')}, "
        "trs AS (SELECT conv_id, turn FROM lb WHERE reason = 'keep' AND split = 'train'), "
        f"cnt AS (SELECT (count(*) + {bs - 1}) // {bs} AS nb FROM trs), "
        f"o AS (SELECT conv_id, turn, epoch, row_number() OVER (PARTITION BY epoch ORDER BY "
        f"{seeded(['epoch', 'conv_id', 'turn'], cfg.seed)}, conv_id, turn) - 1 AS pos "
        f"FROM trs, (SELECT range AS epoch FROM range({cfg.epochs}))), "
        f"b AS (SELECT o.*, o.pos // {bs} AS micro, cnt.nb // {a} AS groups FROM o, cnt) "
        "SELECT conv_id, turn, CAST(epoch AS INTEGER) AS epoch, pos, micro, "
        f"epoch * groups + micro // {a} + 1 AS step FROM b WHERE micro < groups * {a}"
    )


def _prompt_registry() -> str:
    rows = [(i, "code", i + 1, f"Code Prompt {i + 1}", p) for i, p in enumerate(C.CODE_PROMPTS)]
    rows += [(i + 5, "instruction", i + 1, f"Instruction Prompt {i + 1}", p) for i, p in enumerate(C.INSTRUCTION_PROMPTS)]
    values = ", ".join(f"({s}, {q(k)}, {o}, {q(l)}, {q(p)})" for s, k, o, l, p in rows)
    slot = f"(('0x' || substr(md5(concat_ws(':', 'prompt', i.conv_id, i.turn)), 1, 8))::BIGINT % {Q.N_PROMPTS})"
    return (
        f"WITH {INSTR}, reg(slot, kind, ordinal, label, prompt) AS (VALUES {values}), "
        f"{NEXT_USER}, "
        f"c AS (SELECT r.label, r.kind, r.ordinal, r.prompt, r.prompt || {strip_sql('i.output')} || CASE WHEN nx.next_user IS NULL "
        f"THEN '' ELSE {NL} || {NL} || '### Instruction:' || {NL} || nx.next_user END AS text FROM inst i "
        "LEFT JOIN nx ON i.conv_id = nx.conv_id AND i.turn = nx.turn "
        f"JOIN reg r ON r.slot = {slot}), "
        "t AS (SELECT *, substr(text, length(prompt) + 1) AS rest FROM c WHERE kind = 'code'), "
        "tc AS (SELECT *, CASE WHEN strpos(rest, '### Instruction:') > 0 THEN substr(text, 1, length(prompt)) || "
        f"{strip_sql(BEFORE_CUT)} ELSE text END AS trimmed FROM t) "
        "SELECT label, CAST(ordinal AS INTEGER) AS ordinal, count(*) AS n_completions, "
        "CAST(sum(length(trimmed)) AS BIGINT) AS trimmed_chars FROM tc GROUP BY label, ordinal"
    )


def _steps(cfg=Q.METRIC_RUN) -> str:
    return f"WITH {EVENTS_MICRO}, {steps_cte(cfg.grad_accum, cfg.effective_batch, cfg.context)}"


def _spike_report(thr: float = C.GRAD_SKIP_THRESHOLD) -> str:
    return (
        f"{_steps()}, cnt AS (SELECT run_id, count(*) AS n_steps, count(*) FILTER (WHERE grad_norm <= {thr}) AS n_logged, "
        f"count(*) FILTER (WHERE grad_norm > {thr}) AS n_skipped, CAST(coalesce(min(step) FILTER (WHERE grad_norm > {thr}), 0) AS BIGINT) AS first_skipped_step, "
        "max(grad_norm) AS max_grad_norm, max(step) AS last_step FROM s GROUP BY run_id), "
        f"lg AS (SELECT run_id, step FROM s WHERE grad_norm <= {thr}), "
        "gp AS (SELECT l.run_id, count(*) AS n_gaps FROM lg l JOIN cnt ON l.run_id = cnt.run_id WHERE l.step < cnt.last_step "
        "AND NOT EXISTS (SELECT 1 FROM lg x WHERE x.run_id = l.run_id AND x.step = l.step + 1) GROUP BY l.run_id) "
        "SELECT cnt.run_id, n_steps, n_logged, n_skipped, first_skipped_step, max_grad_norm, last_step, "
        "CAST(coalesce(gp.n_gaps, 0) AS BIGINT) AS n_gaps FROM cnt LEFT JOIN gp ON cnt.run_id = gp.run_id"
    )


def _masked_nll() -> str:
    v = C.VOCAB_SIZE
    return (
        f"WITH {INSTR}, {sft_split_cte()}, {_sft_samples('ssp')}, kept AS (SELECT * FROM lb WHERE reason = 'keep'), "
        "cn AS (SELECT unnest(input_ids) AS label FROM kept WHERE split = 'train'), "
        "cc AS (SELECT label, count(*) AS c FROM cn GROUP BY label), tot AS (SELECT count(*) AS total FROM cn), "
        f"sc AS (SELECT r.label, -ln((coalesce(cc.c, 0) + 1)::DOUBLE / (tot.total + {v})::DOUBLE) AS nll "
        f"FROM (SELECT CAST(range AS INTEGER) AS label FROM range({v})) r LEFT JOIN cc ON r.label = cc.label, tot), "
        "tkr AS (SELECT split, unnest(labels) AS label, unnest(generate_series(0, len(labels) - 1)) AS pos FROM kept), "
        "vv AS (SELECT tkr.split, sc.nll FROM tkr JOIN sc ON tkr.label = sc.label WHERE tkr.pos > 0 AND tkr.label <> -100) "
        "SELECT split, round(avg(nll), 6) AS mean_nll, count(*) AS n_tokens, round(exp(avg(nll)), 6) AS perplexity "
        "FROM vv GROUP BY split"
    )


def _code_cte() -> str:
    """Source texts as ``queries.code_documents`` makes them, with what makes each invalid written out."""
    head = q(Q.CODE_HEAD).replace("\n", "' || chr(10) || '")
    plain = f"{head} || replace(regexp_replace(text, '[^ -~\\n]', '?', 'g'), chr(10), chr(10) || '# ') || chr(10)"
    return (
        f"src AS (SELECT doc_id, lang, doc_id % 8 AS kind, length(text) AS n, {plain} AS code FROM documents), "
        "code AS (SELECT doc_id, lang, kind, CASE kind "
        "WHEN 2 THEN code || 'unclosed = (1, 2' || chr(10) "
        "WHEN 3 THEN code || '# ' || chr(0) || chr(10) "
        f"WHEN 4 THEN replace(code, {head}, 'y = 41 + 1' || chr(10) || 'print(y)' || chr(10) || '# ') "
        "WHEN 5 THEN '# DO NOT EDIT' || chr(10) || code "
        "WHEN 6 THEN code || '# ' || repeat('-----+-----|===== # ', CAST(n AS INTEGER)) "
        "ELSE code END AS text FROM src)"
    )


def _funnel_code() -> str:
    r = reason_sql("text", "code")
    return (
        f"WITH {_code_cte()}, rs AS (SELECT lang, kind, {r} AS reason FROM code) "
        "SELECT lang, CASE WHEN reason = 'keep' AND kind = 2 THEN 'syntax' ELSE reason END AS reason, count(*) AS n_docs "
        "FROM rs GROUP BY 1, 2"
    )


def _eval_report() -> str:
    v = C.VOCAB_SIZE
    return (
        f"{SPLIT}, tkn AS (SELECT chunk_id, split, r - (n - greatest(1, floor(n * {C.VAL_FRACTION}::DOUBLE))) AS place, "
        "unnest(string_split(ids_text, ' '))::INTEGER AS label, unnest(generate_series(0, len(string_split(ids_text, ' ')) - 1)) AS pos FROM sp), "
        "cc AS (SELECT label, count(*) AS c FROM tkn WHERE split = 'train' GROUP BY label), "
        "tot AS (SELECT count(*) AS total FROM tkn WHERE split = 'train'), "
        f"nl AS (SELECT CAST(floor(place / {Q.E_BATCH}) AS BIGINT) AS batch, -ln((coalesce(cc.c, 0) + 1)::DOUBLE / (tot.total + {v})::DOUBLE) AS nll "
        "FROM tkn LEFT JOIN cc ON tkn.label = cc.label, tot WHERE split = 'val' AND pos > 0), "
        f"bl AS (SELECT batch, avg(nll) AS loss FROM nl WHERE batch < {C.EVAL_MAX_BATCHES} GROUP BY batch), "
        "rate AS (SELECT avg(CASE WHEN doc_id % 8 IN (2, 3) THEN 0.0 ELSE 1.0 END) AS p FROM documents WHERE text IS NOT NULL) "
        "SELECT 'unigram' AS run_id, CAST(0 AS BIGINT) AS step, round((SELECT avg(loss) FROM bl), 6) AS val_loss, "
        "round(exp((SELECT avg(loss) FROM bl)), 6) AS val_perplexity, round((SELECT p FROM rate), 6) AS syntax_pass_rate"
    )


def _stream_pack(block: int = C.BLOCK, salt: int = Q.STREAM_SALT, budget: int | None = None) -> str:
    sub = f"CAST((('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % {salt}) AS INTEGER)"
    part = f"(doc_id - (SELECT min(doc_id) FROM documents)) * {Q.STREAM_PARTS} // (SELECT max(doc_id) - min(doc_id) + 1 FROM documents)"
    # a chunk is written when the part that completes it has arrived
    full = f" HAVING count(*) = {block}" if budget else ""
    cut = f" ORDER BY arrived, source, sub, chunk_idx LIMIT {budget}" if budget else ""
    return (
        f"WITH kept AS (SELECT doc_id, source, {sub} AS sub, {part} AS part, text FROM documents WHERE {R} = 'keep'), "
        f"tok AS (SELECT doc_id, source, sub, part, list_append({Q_IDS}, 0) AS ids FROM kept), "
        "st AS (SELECT source, sub, part, doc_id, ids, len(ids) AS n, sum(len(ids)) OVER (PARTITION BY source, sub "
        "ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - len(ids) AS start FROM tok), "
        "flat AS (SELECT source, sub, part, start + unnest(generate_series(0, n - 1)) AS gpos, unnest(ids) AS id FROM st), "
        f"ch AS (SELECT source, sub, gpos // {block} AS chunk_idx, string_agg(id::VARCHAR, ' ' ORDER BY gpos) AS ids_text, "
        f"count(*) AS n, max(part) AS arrived FROM flat GROUP BY 1, 2, 3{full}) "
        "SELECT source, sub, CAST(chunk_idx AS BIGINT) AS chunk_idx, "
        f"{'' if budget else 'CAST(n AS INTEGER) AS n_tokens, '}md5(ids_text) AS ids_md5 FROM ch{cut}"
    )


def _stream_progress(every: int = Q.PROGRESS_EVERY) -> str:
    chunks = _stream_pack(budget=1)
    chunks = chunks[: chunks.index("SELECT source, sub, CAST(chunk_idx")]
    return (
        f"{chunks}, a AS (SELECT arrived, sum(count(*)) OVER (ORDER BY arrived) AS upto FROM ch GROUP BY arrived), "
        f"m AS (SELECT unnest(generate_series({every}, (SELECT max(upto)::BIGINT FROM a), {every})) AS chunks) "
        "SELECT (SELECT min(arrived) FROM a WHERE upto >= m.chunks) AS batch, chunks, "
        f"chunks * {C.BLOCK} AS tokens, CAST(100.0 AS DOUBLE) * (chunks * {C.BLOCK}) / CAST({C.TARGET_TOKENS} AS DOUBLE) AS pct_of_target FROM m"
    )


Q_IDS = ids_sql("text")
FUNNEL = f"SELECT lang, reason, count(*) AS n_docs FROM (SELECT lang, {R} AS reason FROM documents) GROUP BY lang, reason"


def _logged_steps() -> str:
    return (
        f"{_steps()} SELECT CAST(run_id AS VARCHAR) AS run_id, step, train_loss, grad_norm, tokens_seen, "
        "round(3e-4::DOUBLE * CASE WHEN step < 4 THEN step / 4.0::DOUBLE "
        "ELSE 0.1::DOUBLE + 0.45::DOUBLE * (1 + cos(pi() * (step - 4) / 16.0::DOUBLE)) END, 12) AS learning_rate "
        f"FROM s WHERE grad_norm <= {C.GRAD_SKIP_THRESHOLD}"
    )


def oracles() -> dict[str, str]:
    budget = math.ceil(Q.BUDGET_TOKENS / C.BLOCK)
    every = Q.PROGRESS_EVERY
    nulled = "CASE WHEN user_id % 5 <> 0 THEN user_id END"
    mf = Q.MANIFEST
    resume_consumed = Q.RESUME_STEP * mf.grad_accum
    tokens_per_step = mf.effective_batch * mf.context
    resume = (
        f"{_manifest_ctes()} SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(epoch AS INTEGER) AS epoch, micro, step, "
        f"CAST({resume_consumed} // nb AS BIGINT) AS resume_epoch, CAST({resume_consumed} % nb AS BIGINT) AS resume_skip "
        f"FROM mf WHERE step > {Q.RESUME_STEP}"
    )
    return {
        "quality_signals": _quality_signals(),
        "reject_reason": f"SELECT doc_id, {R} AS reason FROM documents",
        "reject_funnel": FUNNEL,
        "reject_funnel_totals": (
            f"SELECT reason, source, lang, count(*) AS n_docs, CAST(grouping(reason, source, lang) AS INTEGER) AS grouping_id "
            f"FROM (SELECT source, lang, {R} AS reason FROM documents) GROUP BY ROLLUP (reason, source, lang)"
        ),
        "reject_funnel_code": _funnel_code(),
        "quality_filter_prose": f"SELECT doc_id, n_chars FROM documents WHERE {R} = 'keep'",
        "token_stats": (
            f"WITH t AS (SELECT lang, {count_sql('text')} + 1 AS n FROM documents WHERE text IS NOT NULL) "
            "SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(min(n) AS INTEGER) AS min_tokens, "
            "CAST(max(n) AS INTEGER) AS max_tokens, avg(n) AS avg_tokens FROM t GROUP BY lang"
        ),
        "running_offset": f"WITH {KEPT}, {TOKENS}, {STARTS} SELECT doc_id, CAST(n AS INTEGER) AS n_tokens, "
                          "CAST(start AS BIGINT) AS start FROM st",
        "packed_chunks": f"{PACKED} SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(n_tokens AS INTEGER) AS n_tokens, "
                         "md5(ids_text) AS ids_md5, CAST(ids_sum AS BIGINT) AS ids_sum FROM ch",
        "token_budget": f"WITH {KEPT}, {TOKENS}, {STARTS}, {chunks_cte(limit_chunks=budget)} "
                        "SELECT CAST(chunk_id AS BIGINT) AS chunk_id, md5(ids_text) AS ids_md5 FROM ch",
        "pack_progress": (
            f"{PACKED} SELECT CAST(chunk_id + 1 AS BIGINT) AS chunks, CAST((chunk_id + 1) * {C.BLOCK} AS BIGINT) AS tokens, "
            f"CAST(100.0 AS DOUBLE) * ((chunk_id + 1) * {C.BLOCK}) / CAST({C.TARGET_TOKENS} AS DOUBLE) AS pct_of_target "
            f"FROM ch WHERE (chunk_id + 1) % {every} = 0"
        ),
        "seeded_order": (
            f"{PACKED} SELECT CAST(chunk_id AS BIGINT) AS chunk_id, {seeded(['chunk_id'], C.DATA_SEED)} AS order_key, "
            f"row_number() OVER (ORDER BY {seeded(['chunk_id'], C.DATA_SEED)}, chunk_id) - 1 AS rank FROM ch"
        ),
        "split_fraction": f"{PACKED}, {corpus_split_cte(Q.SPLIT_FRACTION)} SELECT CAST(chunk_id AS BIGINT) AS chunk_id, split FROM sp",
        "split_exact": f"{SPLIT} SELECT CAST(chunk_id AS BIGINT) AS chunk_id, split FROM sp",
        "dataset_summary": (
            f"{SPLIT}, a AS (SELECT count(*) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS total_tokens FROM tok), "
            "b AS (SELECT count(*) AS n_chunks, count(*) FILTER (WHERE split = 'train') AS train_chunks, "
            "count(*) FILTER (WHERE split = 'val') AS val_chunks FROM sp) "
            f"SELECT n_docs, total_tokens, n_chunks, train_chunks, val_chunks, n_chunks * {C.BLOCK} AS chunk_tokens, "
            f"total_tokens - n_chunks * {C.BLOCK} AS tail_tokens, "
            f"coalesce(n_chunks * {C.BLOCK} / total_tokens, 0.0) AS utilisation FROM a, b"
        ),
        "dataset_summary_budget": (
            f"WITH {KEPT}, {TOKENS}, {STARTS}, {chunks_cte(limit_chunks=budget)}, {corpus_split_cte()}, "
            f"a AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total_tokens FROM st WHERE start < {budget * C.BLOCK}), "
            "b AS (SELECT count(*) AS n_chunks, count(*) FILTER (WHERE split = 'train') AS train_chunks, "
            "count(*) FILTER (WHERE split = 'val') AS val_chunks FROM sp) "
            f"SELECT n_docs, total_tokens, n_chunks, train_chunks, val_chunks, n_chunks * {C.BLOCK} AS chunk_tokens, "
            f"total_tokens - n_chunks * {C.BLOCK} AS tail_tokens, "
            f"coalesce(n_chunks * {C.BLOCK} / total_tokens, 0.0) AS utilisation FROM a, b"
        ),
        "instructions_from_turns": f"WITH {INSTR} SELECT conv_id, turn, instruction, input, output FROM inst",
        "instructions_read": (
            f"WITH {INSTR} SELECT count(*) AS n_rows, TRUE AS keys_unique, count(input) AS n_with_input, "
            f"CAST(sum(length({format_sql()})) AS BIGINT) AS n_chars FROM inst"
        ),
        "sft_format": f"WITH {INSTR} SELECT conv_id, turn, {format_sql()} AS text FROM inst",
        "sft_masked_labels": _sample_report(Q.SFT),
        "sft_truncated": _sample_report(Q.SFT_SHORT),
        "sft_summary": _sft_summary(Q.SFT),
        "sft_summary_strict": _sft_summary(Q.SFT_STRICT),
        "sft_split": f"WITH {INSTR}, {sft_split_cte()} SELECT conv_id, turn, split FROM ssp",
        "sft_collated": (
            f"WITH {INSTR}, {sft_split_cte()}, {_sft_samples('ssp')}, kept AS (SELECT *, row_number() OVER (PARTITION BY split "
            f"ORDER BY {seeded(['conv_id', 'turn'], Q.SFT.seed)}, conv_id, turn) - 1 AS pos FROM lb WHERE reason = 'keep'), "
            f"bt AS (SELECT *, pos // {Q.SFT.batch_size} AS batch_id FROM kept), "
            "bl AS (SELECT *, max(n_tokens) OVER (PARTITION BY split, batch_id) AS batch_len FROM bt) "
            "SELECT split, batch_id, pos, conv_id, turn, CAST(batch_len AS INTEGER) AS batch_len, "
            "md5(array_to_string(list_concat(input_ids, list_transform(range(batch_len - n_tokens), lambda x: 0)), ' ')) AS ids_md5, "
            "md5(array_to_string(list_concat(labels, list_transform(range(batch_len - n_tokens), lambda x: -100)), ' ')) AS labels_md5, "
            "md5(array_to_string(list_concat(list_transform(range(n_tokens), lambda x: 1), "
            "list_transform(range(batch_len - n_tokens), lambda x: 0)), ' ')) AS mask_md5 FROM bl"
        ),
        "supervised_tokens": (
            f"WITH {INSTR}, {_sft_samples('inst')} SELECT conv_id, turn, CAST({n_supervised_sql()} AS INTEGER) AS n_supervised "
            "FROM lb WHERE reason = 'keep'"
        ),
        "epoch_order": (
            f"{PACKED} SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(epoch AS INTEGER) AS epoch, row_number() OVER "
            f"(PARTITION BY epoch ORDER BY {seeded(['epoch', 'chunk_id'], C.DATA_SEED)}, chunk_id) - 1 AS pos, "
            f"count(*) OVER (PARTITION BY epoch) AS n_per_epoch FROM ch, (SELECT range AS epoch FROM range({Q.EPOCHS}))"
        ),
        "sft_manifest": _sft_manifest(),
        "batch_manifest": (
            f"{_manifest_ctes()} SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(epoch AS INTEGER) AS epoch, pos, micro, "
            f"global_micro, step, step * {tokens_per_step} AS tokens_seen FROM mf"
        ),
        "resume_point": resume,
        "resume_stored": resume,
        "val_loss_perplexity": (
            f"WITH {EVENTS_MICRO}, l AS (SELECT run_id, CAST(sum(loss) FILTER (micro_idx < {Q.E_MAX_BATCHES}) AS DOUBLE) "
            f"/ count(*) FILTER (micro_idx < {Q.E_MAX_BATCHES}) AS val_loss, count(*) FILTER (micro_idx < {Q.E_MAX_BATCHES}) AS n_batches, "
            "count(*) AS n_available FROM m GROUP BY run_id) "
            "SELECT run_id, val_loss, n_batches, n_available, round(exp(val_loss), 6) AS val_perplexity FROM l"
        ),
        "masked_nll": _masked_nll(),
        "completion_trim": (
            f"WITH {_completions()} SELECT conv_id, turn, CAST(length(prompt) AS INTEGER) AS prompt_chars, "
            "trimmed <> text AS was_cut, trimmed AS text FROM tc"
        ),
        "prompt_registry": _prompt_registry(),
        "syntax_pass_rate": (
            "SELECT lang, round(avg(CASE WHEN doc_id % 8 IN (2, 3) THEN 0.0 ELSE 1.0 END), 6) AS syntax_pass_rate, "
            "count(*) AS n_texts FROM documents GROUP BY lang"
        ),
        "eval_report": _eval_report(),
        "eval_report_sink": _eval_report(),
        "step_loss_null_run": (
            f"WITH {EVENTS_MICRO.replace('user_id AS run_id', nulled + ' AS run_id').replace('PARTITION BY user_id', 'PARTITION BY ' + nulled)}, "
            f"{steps_cte(Q.METRIC_RUN.grad_accum, Q.METRIC_RUN.effective_batch, Q.METRIC_RUN.context)} "
            "SELECT run_id, step, train_loss, grad_norm, tokens_seen FROM s"
        ),
        "step_loss": f"{_steps()} SELECT run_id, step, train_loss, grad_norm, tokens_seen FROM s",
        "step_sample": f"{_steps()} SELECT run_id, step, train_loss, grad_norm, tokens_seen FROM s "
                       f"WHERE step % {Q.SAMPLE_EVERY} = 0",
        "spike_report": _spike_report(),
        "corpus_build_val": (
            f"{SPLIT} SELECT CAST(chunk_id AS BIGINT) AS chunk_id, "
            f"CAST(r - (n - greatest(1, floor(n * {C.VAL_FRACTION}::DOUBLE))) AS BIGINT) AS pos, "
            "md5(ids_text) AS ids_md5 FROM sp WHERE split = 'val'"
        ),
        "corpus_build_train": (
            f"{SPLIT} SELECT CAST(chunk_id AS BIGINT) AS chunk_id, md5(ids_text) AS ids_md5 FROM sp WHERE split = 'train'"
        ),
        "step_metrics_csv": _logged_steps(),
        "step_metrics_stream": _logged_steps(),
        "stream_tokenize": f"WITH {KEPT}, {TOKENS} SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens, "
                           "md5(array_to_string(ids, ' ')) AS ids_md5 FROM tok",
        "stream_pack": _stream_pack(),
        "stream_budget": _stream_pack(budget=Q.STREAM_BUDGET),
        "stream_funnel": FUNNEL,
        "stream_progress": _stream_progress(),
    }
