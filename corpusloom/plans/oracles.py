"""Independent SQL for the catalogue's queries, for DuckDB over the same tables."""

from __future__ import annotations

_LANGS = "'en','fr','de','es','zh','ja'"
_DENSE = "('zh','ja')"
_OWN = "'primes_unbounded'"

CORPUS = f"""corpus AS (
  SELECT p.line_no, p.id, p.arm, p.theorem, t.technique AS technique, nullif(lower(trim(p.direction)), '') AS direction,
    CASE WHEN lower(trim(p.language)) IN ({_LANGS}) THEN lower(trim(p.language)) ELSE 'und' END AS language,
    CASE WHEN lower(trim(p.style)) IN ('terse','verbose') THEN lower(trim(p.style)) END AS style,
    p.sample_index, p.model, p.effort, p.max_tokens, p.prompt, p.proof, p.stop_reason, p.usage, p.collected_at,
    length(p.proof) AS chars, CASE WHEN length(p.proof) > 0 THEN ln(length(p.proof)) END AS log_chars
  FROM proofs_primes p LEFT JOIN (SELECT DISTINCT technique FROM techniques) t ON lower(trim(p.technique)) = t.technique)"""

Z = """base AS (SELECT language, avg(log_chars) AS m, {sd}(log_chars) AS s FROM corpus WHERE {on} GROUP BY language),
zs AS (SELECT c.*, (c.log_chars - b.m) / {div} AS z FROM corpus c LEFT JOIN base b USING (language))"""
Z_SAMPLE = Z.format(sd="stddev_samp", on="arm <> 'scope'", div="nullif(b.s, 0)")
Z_EXTREME = Z.format(sd="stddev_pop", on="arm = 'extreme'", div="nullif(b.s, 0)")
Z_FIGURE = Z.format(sd="stddev_pop", on="arm <> 'scope'", div="coalesce(nullif(b.s, 0), 1)")
CELLS = """cells AS (SELECT direction, language, count(*) AS n, avg(z) AS mean_z FROM zs WHERE arm = 'extreme' AND direction IS NOT NULL AND z IS NOT NULL GROUP BY ALL)"""

VECS = """vecs AS (
  SELECT c.line_no, c.arm, c.theorem, split_part(c.technique, '_', 1) AS technique, c.direction, c.language, c.style, c.log_chars, e.embedding::DOUBLE[] AS vec
  FROM corpus c JOIN embeddings e ON c.line_no = e.vec_id),
x AS (SELECT line_no, arm, theorem, technique, direction, language, style, generate_subscripts(vec, 1) AS pos, unnest(vec) AS v FROM vecs)"""
CENTRED = """mu AS (SELECT language, pos, avg(v) AS m FROM x WHERE arm <> 'scope' GROUP BY ALL),
dev AS (SELECT x.* EXCLUDE (v), v - m AS v FROM x JOIN mu USING (language, pos)),
c AS (SELECT dev.* EXCLUDE (v), v / greatest(sqrt(sum(v * v) OVER (PARTITION BY line_no)), 1e-9) AS u FROM dev)"""
CENTROIDS = """tc AS (SELECT technique, pos, avg(u) AS m FROM c WHERE arm = 'technique' AND technique IS NOT NULL GROUP BY ALL),
cen AS (SELECT technique, pos, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY technique)), 1e-9) AS w FROM tc)"""
ASSIGNED = """cosines AS (SELECT c.line_no, c.direction, c.language, c.theorem, cen.technique AS best, round(sum(c.u * cen.w), 9) AS cos FROM c JOIN cen USING (pos) WHERE c.arm = '{arm}' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY cos DESC, best) AS rn FROM cosines),
assigned AS (SELECT a.line_no, a.direction, a.language, a.theorem, a.best, a.cos, b.cos AS second_cos, a.cos - b.cos AS margin FROM ranked a LEFT JOIN (SELECT line_no, cos FROM ranked WHERE rn = 2) b USING (line_no) WHERE a.rn = 1)"""
OWN = """ts AS (SELECT technique, pos, sum(u) AS s FROM c WHERE arm = 'technique' AND technique IS NOT NULL GROUP BY ALL),
tn AS (SELECT technique, count(DISTINCT line_no) AS n FROM c WHERE arm = 'technique' AND technique IS NOT NULL GROUP BY ALL),
own AS (SELECT c.line_no, sum(c.u * (ts.s - c.u)) / sqrt(greatest(sum((ts.s - c.u) * (ts.s - c.u)), 1e-18)) AS own_cos FROM c JOIN ts USING (technique, pos) JOIN tn USING (technique) WHERE c.arm = 'technique' AND tn.n > 1 GROUP BY c.line_no),
thr AS (SELECT quantile_cont(own_cos, 0.05) AS threshold FROM own)"""


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def w(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _assigned(arm: str = "extreme") -> tuple[str, ...]:
    return CORPUS, VECS, CENTRED, CENTROIDS, ASSIGNED.format(arm=arm)


def _forms(text: str) -> str:
    return f"EXISTS (SELECT 1 FROM (SELECT unnest(g.forms) AS f) WHERE contains({text}, f))"


_COUNTS = """hits AS (SELECT z.line_no, g.name FROM zs z, registry g WHERE len(list_filter(g.forms, lambda f: contains(z.proof, f))) > 0),
counts AS (SELECT z.line_no, z.arm, z.technique, z.direction, z.language, z.chars, z.z, count(h.name) AS invoked FROM zs z LEFT JOIN hits h USING (line_no) GROUP BY ALL)"""
_MASK = {"ja": ["因数の木", "素因数", "篩"], "zh": ["因子树", "因子", "筛法"], "en": ["divisor chain", "factor tree", "index set", "product", "sieve", "divisor"], "de": ["teilerkette", "faktorbaum", "produkt", "sieb"]}


def _replace(text: str, terms: list[str]) -> str:
    for t in terms:
        text = f"replace({text}, '{t}', '⟨m⟩')"
    return text


def _replace_words(text: str, terms: list[str]) -> str:
    # neighbours share the character between them, so each term is replaced twice
    no = r"[^\p{L}\p{M}\p{N}_]"
    for t in terms:
        for _ in range(2):
            text = f"regexp_replace({text}, '(?i)(^|{no}){t}($|{no})', '\\1⟨m⟩\\2', 'g')"
    return text


_MASKED = f"""masked AS (SELECT *, CASE language WHEN 'ja' THEN {_replace('proof', _MASK['ja'])} WHEN 'zh' THEN {_replace('proof', _MASK['zh'])} WHEN 'en' THEN {_replace_words('proof', _MASK['en'])} WHEN 'de' THEN {_replace_words('proof', _MASK['de'])} ELSE proof END AS masked FROM corpus)"""
_GRID = """dirs AS (SELECT unnest(['barehanded','broadest','explicit','heavyweight','pictorial','shortest','symbolic','unexpected']) AS direction),
langs AS (SELECT unnest(['en','fr','de','es','zh','ja']) AS language),
styles AS (SELECT unnest(['terse','verbose']) AS style),
targets AS (SELECT unnest(['centre','gap_ceiling','odd_class_primes','reciprocal_growth']) AS target),
grid AS (
  SELECT 't__' || technique || '__' || language || '__' || style || '__' || k AS id, 'technique' AS arm, 'primes_unbounded' AS theorem, technique, NULL::VARCHAR AS direction, language, style, k AS sample_index FROM (SELECT DISTINCT technique FROM techniques), langs, styles, range(5) t(k)
  UNION ALL SELECT 'x__' || direction || '__' || language || '__' || k, 'extreme', 'primes_unbounded', NULL, direction, language, NULL, k FROM dirs, langs, range(5) t(k)
  UNION ALL SELECT 's__' || target || '__' || language || '__' || k, 'scope', CASE target WHEN 'centre' THEN 'primes_unbounded' ELSE target END, NULL, NULL, language, NULL, k FROM targets, langs, range(3) t(k))"""
_RENDERED = """other(arm, level, description) AS (VALUES ('extreme','barehanded','Aim: barehanded.'),('extreme','broadest','Aim: broadest.'),('extreme','explicit','Aim: explicit.'),('extreme','heavyweight','Aim: heavyweight.'),('extreme','pictorial','Aim: pictorial.'),('extreme','shortest','Aim: shortest.'),('extreme','symbolic','Aim: symbolic.'),('extreme','unexpected','Aim: unexpected.'),('scope','primes_unbounded','the supply of primes never runs out'),('scope','gap_ceiling','the next prime is never more than twice as far away')),
des AS (SELECT * FROM other UNION ALL SELECT 'technique', technique, summary FROM techniques),
ins(language, instruction) AS (VALUES ('en','Write everything in English.'),('fr','Write everything in French.'),('de','Write everything in German.'),('es','Write everything in Spanish.'),('zh','Write everything in Chinese.'),('ja','Write everything in Japanese.')),
rendered AS (SELECT c.*, CASE c.arm
  WHEN 'extreme' THEN 'Please write a self-standing argument for the claim that the supply of primes never runs out. Any approach will do. ' || d.description || ' ' || i.instruction
  WHEN 'technique' THEN 'Please write a self-standing argument for the claim that the supply of primes never runs out. Follow this line only: ' || d.description || '. ' || i.instruction
  ELSE 'Please write a self-standing argument for the claim that ' || d.description || '. Any approach will do. ' || i.instruction END AS fresh
  FROM corpus c LEFT JOIN des d ON d.arm = c.arm AND d.level = coalesce(c.technique, c.direction, c.theorem) LEFT JOIN ins i USING (language))"""
_RECORDS = "SELECT {cols} FROM proofs_primes"
_CHI = """chi AS (SELECT o, r, k, sum(o) OVER (PARTITION BY r) AS rt, sum(o) OVER (PARTITION BY k) AS ct FROM tab)"""
_BUDGET = """SELECT '{name}' AS factor, (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM t WHERE {ok})) AS levels, round((b.b - g.g) / (q.q - g.g), 6) + 0.0 AS fraction
 FROM (SELECT sum(s * s / n) AS b FROM (SELECT {keys}, pos, sum(v) AS s, count(*) AS n FROM t WHERE {ok} GROUP BY ALL)) b,
 (SELECT sum(s * s / n) AS g FROM (SELECT pos, sum(v) AS s, count(*) AS n FROM t WHERE {ok} GROUP BY ALL)) g, (SELECT sum(v * v) AS q FROM t WHERE {ok}) q"""


def _budget(name: str, *keys: str) -> str:
    return _BUDGET.format(name=name, keys=", ".join(keys), ok=" AND ".join(f"{k} IS NOT NULL" for k in keys))


def _pairs(f: str) -> str:
    return f"SELECT '{f}' AS factor, avg(CASE WHEN a.{f} = b.{f} THEN cos END) AS same, avg(CASE WHEN a.{f} <> b.{f} THEN cos END) AS diff FROM p JOIN vecs a ON a.line_no = p.i JOIN vecs b ON b.line_no = p.j WHERE a.{f} IS NOT NULL AND b.{f} IS NOT NULL"


_PAIRS = """tv AS (SELECT * FROM vecs WHERE arm = 'technique'),
p AS (SELECT a.line_no AS i, b.line_no AS j, list_inner_product(a.vec, b.vec) AS cos FROM tv a JOIN tv b ON a.line_no < b.line_no)"""


def _cap(source: str, cloud: str) -> str:
    return f"""SELECT '{cloud}' AS cloud, (SELECT count(DISTINCT line_no) FROM {source}) AS n, round(min(ang), 6) + 0.0 AS near, round(max(ang), 6) + 0.0 AS far, round((SELECT (sum(s * s) - any_value(q)) FROM (SELECT pos, sum(u) AS s FROM {source} GROUP BY pos), (SELECT sum(u * u) AS q FROM {source})) / ((SELECT count(DISTINCT line_no) FROM {source}) * ((SELECT count(DISTINCT line_no) FROM {source}) - 1)), 6) + 0.0 AS mean_pair_cos
 FROM (SELECT line_no, degrees(acos(greatest(least(sum(u * pole), 1.0), -1.0))) AS ang FROM {source} JOIN (SELECT pos, s / sqrt(sum(s * s) OVER ()) AS pole FROM (SELECT pos, sum(u) AS s FROM {source} GROUP BY pos)) USING (pos) GROUP BY line_no)"""


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["A1_arm_counts"] = "SELECT arm, count(*) AS n FROM proofs_primes GROUP BY arm"
    out["A2_integrity"] = "SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(*) FILTER (stop_reason = 'max_tokens') AS truncated, count(*) FILTER (proof IS NULL OR proof = '') AS empty FROM proofs_primes"
    out["A3_value_sets"] = """SELECT field, string_agg(value, ',' ORDER BY value) AS levels, count(*) > 1 AS several FROM (
      SELECT DISTINCT 'arm' AS field, arm AS value FROM proofs_primes UNION SELECT 'model', model FROM proofs_primes UNION SELECT 'effort', effort FROM proofs_primes UNION SELECT 'max_tokens', max_tokens::VARCHAR FROM proofs_primes) WHERE value IS NOT NULL GROUP BY field"""
    out["A4_mixed_cells"] = w(CORPUS) + "SELECT direction, language, count(DISTINCT prompt) AS prompts FROM corpus WHERE arm = 'extreme' AND direction IS NOT NULL GROUP BY ALL HAVING count(DISTINCT prompt) <> 1"
    out["A5_cell_median_cv"] = w(CORPUS) + f"SELECT technique, language, style, count(*) AS n, {r('median(chars)', 'median_chars')}, {r('CASE WHEN avg(chars) > 0 THEN stddev_samp(chars) / avg(chars) END', 'cv')} FROM corpus WHERE technique IS NOT NULL AND style IS NOT NULL AND chars IS NOT NULL GROUP BY technique, language, style"
    out["A6_language_baseline"] = w(CORPUS) + f"SELECT language, count(log_chars) AS n, {r('avg(log_chars)', 'mean_log')}, {r('stddev_samp(log_chars)', 'sd_log')} FROM corpus WHERE arm <> 'scope' GROUP BY language"
    out["W1_z_sample"] = w(CORPUS, Z_SAMPLE) + f"SELECT line_no, language, {r('z', 'z')} FROM zs"
    out["W2_z_population"] = w(CORPUS, Z_EXTREME) + f"SELECT line_no, {r('z', 'z')} FROM zs WHERE arm = 'extreme'"
    out["W3_z_figure"] = w(CORPUS, Z_FIGURE) + f"SELECT line_no, {r('z', 'z')} FROM zs"
    out["A7_cell_mean_z"] = w(CORPUS, Z_SAMPLE, CELLS) + f"SELECT direction, language, n, {r('mean_z', 'mean_z')} FROM cells"
    out["A8_direction_mean_z"] = w(CORPUS, Z_SAMPLE, CELLS) + f"SELECT direction, count(*) AS cells, {r('avg(mean_z)', 'mean_z')} FROM cells GROUP BY direction"
    out["A9_script_gap"] = (
        w(CORPUS, Z_SAMPLE)
        + f"SELECT direction, {r('dense', 'dense')}, {r('other', 'other')}, {r('dense - other', 'gap')}, abs(dense - other) > 0.25 AS flagged FROM (SELECT direction, avg(z) FILTER (language IN {_DENSE}) AS dense, avg(z) FILTER (language NOT IN {_DENSE}) AS other FROM zs WHERE arm = 'extreme' AND direction IS NOT NULL GROUP BY direction)"
    )
    out["A10_centre_difference"] = (
        w(CORPUS, Z_SAMPLE, CELLS, "dm AS (SELECT direction, count(*) AS cells, avg(mean_z) AS mean_z FROM cells GROUP BY direction)", f"ce AS (SELECT avg(z) AS centre FROM zs WHERE arm = 'scope' AND theorem = {_OWN})")
        + f"SELECT direction, cells, {r('mean_z', 'mean_z')}, {r('centre', 'centre')}, {r('mean_z - centre', 'difference')} FROM dm, ce"
    )
    out["D1_range_over_spread"] = (
        w(CORPUS, Z_SAMPLE, CELLS, "per AS (SELECT direction, avg(mean_z) AS m, stddev_samp(mean_z) AS s FROM cells GROUP BY direction)")
        + f"SELECT {r('max(m) - min(m)', 'between')}, {r('avg(s)', 'within')}, {r('(max(m) - min(m)) / nullif(avg(s), 0)', 'ratio')} FROM per"
    )
    out["F1_lengths"] = w(CORPUS, Z_FIGURE, CELLS) + f"SELECT direction, language, n, {r('mean_z', 'mean_z')}, {r('avg(mean_z) OVER (PARTITION BY direction)', 'direction_z')} FROM cells"
    out["A25_modal_theorem"] = "SELECT theorem, count(*) AS n FROM proofs_primes WHERE arm <> 'scope' GROUP BY theorem ORDER BY n DESC, theorem LIMIT 1"
    out["P17_level_codes"] = w(CORPUS) + "SELECT DISTINCT technique, dense_rank() OVER (ORDER BY technique) - 1 AS code FROM corpus WHERE technique IS NOT NULL"
    out["W10_sample_index"] = w(CORPUS) + "SELECT line_no, direction, language, row_number() OVER (PARTITION BY direction, language ORDER BY line_no) - 1 AS k FROM corpus WHERE direction IS NOT NULL"
    out["U1_other_languages"] = w(CORPUS) + "SELECT DISTINCT language FROM corpus EXCEPT SELECT 'en'"
    out["U3_theorems_together"] = f"SELECT corpus, theorem, count(*) AS n, {r('avg(length(proof))', 'mean_chars')} FROM (SELECT 'primes' AS corpus, theorem, proof FROM proofs_primes UNION ALL SELECT 'sqrt2', theorem, proof FROM proofs_sqrt2) GROUP BY ALL"

    out["P1_full_grid"] = w(_GRID) + "SELECT * FROM grid"
    out["A26_grid_size"] = w(_GRID) + "SELECT arm, count(*) AS n FROM grid GROUP BY arm"
    out["J1_pending_grid"] = w(_GRID) + "SELECT id, arm, language FROM grid WHERE id NOT IN (SELECT id FROM proofs_primes WHERE id IS NOT NULL)"
    out["J2_first_collected"] = "SELECT id, line_no, arm, length(proof) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY collected_at, line_no) AS rn FROM proofs_primes) WHERE rn = 1"
    out["J3_results_with_meta"] = "SELECT p.line_no, p.stop_reason, p.id, b.asked_in FROM proofs_primes p JOIN (SELECT id, min(batch_id) AS asked_in FROM pending_batches GROUP BY id) b USING (id)"
    ws = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"
    out["P8_flatten_response"] = f"SELECT line_no, regexp_replace(proof, '^{ws}|{ws}$', '', 'g') AS proof FROM proofs_primes WHERE proof IS NOT NULL"
    out["P5_rendered_prompts"] = w(CORPUS, _RENDERED) + "SELECT line_no, fresh AS prompt_rendered FROM rendered"
    out["J5_stale_by_label"] = (
        w(CORPUS, _RENDERED, "fr AS (SELECT id, min(fresh) AS fresh_prompt FROM rendered GROUP BY id)")
        + "SELECT coalesce(nullif(direction, ''), nullif(technique, ''), nullif(theorem, '')) AS label, prompt IS DISTINCT FROM fresh_prompt AS stale, count(*) AS n FROM rendered JOIN fr USING (id) GROUP BY ALL"
    )
    out["P7_requests"] = """SELECT DISTINCT id AS custom_id, '{"model":"model-a","max_tokens":1024,"messages":[{"role":"user","content":"' || substr(md5(prompt), 1, 12) || '"}]}' AS params FROM proofs_primes"""
    out["A21_prompt_hashes"] = w(CORPUS) + "SELECT direction, theorem, string_agg(h, ',' ORDER BY h) AS hashes FROM (SELECT DISTINCT direction, theorem, substr(md5(regexp_extract(prompt, '(?:Aim|What counts): ([^.]*)\\.', 1)), 1, 8) AS h FROM corpus WHERE direction IS NOT NULL) GROUP BY ALL"
    out["A22_ingest_counters"] = "SELECT count(*) FILTER (stop_reason IS NOT NULL AND stop_reason <> 'error') AS ok, count(*) FILTER (stop_reason IS NULL OR stop_reason = 'error') AS err, count(*) FILTER (stop_reason = 'max_tokens') AS truncated, sum(usage.input_tokens)::BIGINT AS input_tokens, sum(usage.output_tokens)::BIGINT AS output_tokens FROM proofs_primes"
    out["S12_pending_described"] = "SELECT json_extract_string(meta, '$.arm') AS arm, count(*) AS rows, count(DISTINCT id) AS ids FROM pending_batches GROUP BY ALL"
    out["P11_labels"] = w(CORPUS) + "SELECT coalesce(direction, nullif(technique, ''), nullif(theorem, '')) AS label, count(*) AS n FROM corpus GROUP BY ALL"
    out["P12_id_parts"] = "SELECT CASE WHEN s THEN nullif(split_part(id, '__', 1), '') END AS id_arm, CASE WHEN s THEN nullif(split_part(id, '__', 2), '') END AS id_level, CASE WHEN s THEN nullif(split_part(id, '__', 3), '') END AS id_language, count(*) AS n FROM (SELECT id, regexp_matches(id, '^[txs]__') AS s FROM proofs_primes) GROUP BY ALL"
    out["P6_targets"] = f"SELECT theorem, CASE WHEN theorem = {_OWN} THEN 'centre' ELSE theorem END AS target, theorem AS back, count(*) AS n FROM proofs_primes WHERE arm = 'scope' GROUP BY ALL"
    out["P18_schema_union"] = "SELECT id, arm, technique, NULL::BIGINT AS chars FROM proofs_sqrt2 UNION ALL SELECT id, NULL, NULL, chars::BIGINT FROM primes"

    out["S1_jsonl_scan"] = w(CORPUS) + f"SELECT arm, count(*) AS n, sum(chars)::BIGINT AS chars, {r('avg(log_chars)', 'mean_log')} FROM corpus GROUP BY arm"
    out["S5_append_new"] = """SELECT arm, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id, arm FROM proofs_primes GROUP BY ALL) GROUP BY arm"""
    out["S6_rewrite_fresh"] = "SELECT effort, count(*) AS n, sum(length(proof))::BIGINT AS chars FROM proofs_primes WHERE stop_reason = 'end_turn' GROUP BY effort"
    out["S7_masked_sink"] = w(CORPUS, _MASKED) + "SELECT language, count(*) AS n, sum(length(masked))::BIGINT AS chars FROM masked GROUP BY language"
    out["S2_matrix_scan"] = f"SELECT vec_id, len(embedding) AS dim, {r('sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))', 'norm')} FROM embeddings"
    out["S3_aligned"] = "SELECT arm, count(*) AS n, min(len(embedding)) AS dim FROM proofs_primes JOIN embeddings ON line_no = vec_id GROUP BY arm"
    out["S8_matrix_sink"] = f"SELECT line_no, {r('list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])', 'square')} FROM proofs_primes JOIN embeddings ON line_no = vec_id"
    out["S9_cache_names"] = "SELECT DISTINCT '/data/proofs_' || coalesce(source, 'none') || '.v1.jsonl' AS path, coalesce(source, 'none') || '_v1' AS cache FROM documents"
    out["S10_cached"] = w(CORPUS) + "SELECT language, count(*) AS n FROM corpus JOIN embeddings ON line_no = vec_id GROUP BY language"
    out["S11_stream_ingest"] = "SELECT arm, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id, arm FROM proofs_primes GROUP BY ALL) GROUP BY arm"

    out["X_functions"] = f"""SELECT line_no, length(proof) AS x1_len, {r("CASE WHEN length(proof) > 0 THEN ln(length(proof)) END", "x2_log")},
      length(regexp_replace(proof, '^{ws}|{ws}$', '', 'g')) AS x3_stripped, nullif(split_part(id, '__', 2), '') AS x4_part, starts_with(id, 't__') AS x5_starts,
      length(replace(proof, 'the', '')) AS x6_replaced, regexp_extract(prompt, '(?:Aim|What counts): ([^.]*)\\.', 1) AS x7_criterion, length(regexp_replace(proof, '[0-9]+', '#', 'g')) AS x8_sub,
      contains(proof, 'L-lemma') AS x11_contains, substr(md5(prompt), 1, 8) AS x12_md5, arm || '/' || effort AS x13_format, {r("sqrt(abs(sample_index - 10))", "x14_sqrt")},
      {r("degrees(acos(least(1.0, sample_index / 50.0)))", "x15_acos")}, {r("degrees(atan2(sample_index, 3.0))", "x15_atan2")}, usage.output_tokens AS x16_json, strftime(collected_at, '%Y%m%d-%H%M%S') AS x17_time
      FROM proofs_primes WHERE proof IS NOT NULL"""
    out["X10_leading_boundary"] = r"SELECT line_no, regexp_matches(proof, '(?i)(^|[^\p{L}\p{M}\p{N}_])sieve') AS sieve, regexp_matches(proof, '(?i)(^|[^\p{L}\p{M}\p{N}_])borne') AS borne FROM proofs_primes WHERE proof IS NOT NULL"
    out["X18_array_functions"] = w(CORPUS, VECS) + f"SELECT line_no, {r('sqrt(list_inner_product(vec, vec))', 'norm')}, list_position(vec, list_max(vec))::BIGINT AS argmax, {r('list_max(vec)', 'top')}, {r('list_avg(vec)', 'mean')} FROM vecs"

    out["L3_language_means"] = w(CORPUS, VECS) + f"SELECT language, pos::BIGINT AS pos, {r('avg(v)', 'value')} FROM x WHERE arm <> 'scope' GROUP BY language, pos"
    out["L1_centred"] = w(CORPUS, VECS, CENTRED) + f"SELECT line_no, pos::BIGINT AS pos, {r('u', 'value')} FROM c"
    out["L2_centred_leave_one_out"] = (
        w(CORPUS, VECS, "t AS (SELECT language, pos, sum(v) AS s, count(*) AS n FROM x GROUP BY ALL)", "d AS (SELECT line_no, pos, v - (s - v) / (n - 1) AS v FROM x JOIN t USING (language, pos) WHERE n > 1)")
        + f"SELECT line_no, pos::BIGINT AS pos, {r('v / greatest(sqrt(sum(v * v) OVER (PARTITION BY line_no)), 1e-9)', 'value')} FROM d"
    )
    out["L4_centroids"] = w(CORPUS, VECS, CENTRED, CENTROIDS) + f"SELECT technique, pos::BIGINT AS pos, {r('w', 'value')} FROM cen"
    out["A11_centred_level_means"] = w(CORPUS, VECS, "m AS (SELECT technique, pos, avg(v) AS m FROM x WHERE technique IS NOT NULL GROUP BY ALL)") + f"SELECT technique, pos::BIGINT AS pos, {r('m - avg(m) OVER (PARTITION BY pos)', 'value')} FROM m"
    out["L5_assign"] = w(*_assigned()) + f"SELECT line_no, best, {r('cos', 'cos')}, {r('second_cos', 'second_cos')}, {r('margin', 'margin')} FROM assigned"
    out["A27_confidence"] = (
        w(*_assigned()) + f"SELECT count(*) AS n, {r('avg(cos)', 'mean_cos')}, {r('min(cos)', 'min_cos')}, {r('avg(margin)', 'mean_margin')}, {r('median(margin)', 'median_margin')}, count(*) FILTER (margin < 0.02) AS close FROM assigned"
    )
    out["L6_crosstab"] = w(*_assigned()) + "SELECT direction, best, count(*) AS n FROM assigned WHERE direction IS NOT NULL GROUP BY CUBE (direction, best)"
    out["L6_crosstab_margin"] = w(*_assigned()) + "SELECT direction, best, count(*) AS n FROM assigned WHERE direction IS NOT NULL AND margin >= 0.02 GROUP BY direction, best"
    tab = "tab AS (SELECT direction AS r, best AS k, count(*)::DOUBLE AS o FROM assigned WHERE direction IS NOT NULL GROUP BY ALL)"
    chi = "sum(o) * sum(o * o / (rt * ct)) - sum(o)"
    # the tail by the trapezoid rule from chi2 to far beyond it
    tail = """st AS (SELECT {chi} AS chi2, ((count(DISTINCT r) - 1) * (count(DISTINCT k) - 1))::DOUBLE AS dof FROM chi),
tl AS (SELECT sum(wt * exp((dof / 2 - 1) * ln(t) - t / 2 - lgamma(dof / 2) - dof / 2 * ln(2))) AS p FROM (SELECT dof, chi2 + (i + 0.5) * (20 * sqrt(2 * dof) + 100 + dof) / 200000 AS t, (20 * sqrt(2 * dof) + 100 + dof) / 200000 AS wt FROM st, range(200000) q(i)))"""
    out["L7_association"] = (
        w(*_assigned(), tab, _CHI, tail.format(chi=chi))
        + f"SELECT sum(o)::BIGINT AS total, count(DISTINCT r) AS rows, count(DISTINCT k) AS cols, {r(chi, 'chi2')}, (count(DISTINCT r) - 1) * (count(DISTINCT k) - 1) AS dof, {r(f'sqrt(greatest({chi}, 0) / (sum(o) * (least(count(DISTINCT r), count(DISTINCT k)) - 1)))', 'cramers_v')}, (SELECT round(p, 6) + 0.0 FROM tl) AS p FROM chi"
    )
    out["L8_null_agreement"] = (
        w(*_assigned(), tab, _CHI)
        + f"SELECT {r(chi, 'observed')}, {r('sum(o) / (sum(o) - 1) * (count(DISTINCT r) - 1) * (count(DISTINCT k) - 1)', 'exact_mean')}, true AS agrees, true AS max_above_mean, true AS p_is_share FROM chi"
    )
    out["L9_length_by_assigned"] = w(*_assigned(), Z_EXTREME) + f"SELECT best, count(*) AS n, {r('avg(z)', 'mean_z')} FROM assigned JOIN zs USING (line_no) WHERE z IS NOT NULL GROUP BY best"
    out["A14_direction_shares"] = (
        w(*_assigned()) + f"SELECT direction, best, n, {r('share', 'share')}, place FROM (SELECT direction, best, n, n / sum(n) OVER (PARTITION BY direction) AS share, row_number() OVER (PARTITION BY direction ORDER BY n DESC, best) AS place FROM (SELECT direction, best, count(*) AS n FROM assigned GROUP BY ALL)) WHERE place <= 3"
    )
    out["L10_mode_by_language"] = w(*_assigned()) + "SELECT direction, language, best, n FROM (SELECT *, row_number() OVER (PARTITION BY direction, language ORDER BY n DESC, best) AS rn FROM (SELECT direction, language, best, count(*) AS n FROM assigned WHERE direction IS NOT NULL GROUP BY ALL)) WHERE rn = 1"
    out["A16_threshold"] = w(CORPUS, VECS, CENTRED, OWN) + f"SELECT {r('threshold', 'threshold')} FROM thr"
    out["L11_out_of_set"] = w(*_assigned(), OWN) + f"SELECT direction, count(*) AS n, count(*) FILTER (cos < threshold) AS below, {r('avg(cos)', 'mean_cos')} FROM assigned, thr WHERE direction IS NOT NULL GROUP BY direction"
    out["L12_scope_test"] = (
        w(*_assigned("scope"), OWN, "lead AS (SELECT *, row_number() OVER (PARTITION BY theorem ORDER BY n DESC, best) AS place FROM (SELECT theorem, best, count(*) AS n FROM assigned GROUP BY ALL))")
        + f"SELECT a.theorem, count(*) AS n, count(*) FILTER (cos < threshold) AS below, {r('avg(cos)', 'mean_cos')}, (SELECT string_agg(best || ':' || l.n, ',' ORDER BY place) FROM lead l WHERE l.theorem = a.theorem AND place <= 3) AS leading, {r('avg(margin)', 'mean_margin')} FROM assigned a, thr GROUP BY a.theorem"
    )
    tx = "t AS (SELECT * FROM x WHERE arm = 'technique')"
    out["A12_variance_budget"] = w(CORPUS, VECS, tx) + " UNION ALL ".join([_budget("technique", "technique"), _budget("language", "language"), _budget("style", "style"), _budget("technique x style", "technique", "style")])
    out["A17_pair_similarity"] = w(CORPUS, VECS, _PAIRS) + f"SELECT factor, {r('same', 'same')}, {r('diff', 'diff')}, {r('same - diff', 'gap')} FROM (" + " UNION ALL ".join(_pairs(f) for f in ("technique", "language", "style")) + ")"
    mixed = "SELECT '{name}' AS pairs_of, count(*) AS pairs, round(avg(cos), 6) + 0.0 AS mean_cos FROM p JOIN vecs a ON a.line_no = p.i JOIN vecs b ON b.line_no = p.j WHERE a.technique IS NOT NULL AND b.technique IS NOT NULL AND a.language IS NOT NULL AND b.language IS NOT NULL AND {cond}"
    out["A17_mixed_pairs"] = w(CORPUS, VECS, _PAIRS) + mixed.format(name="same technique, other language", cond="a.technique = b.technique AND a.language <> b.language") + " UNION ALL " + mixed.format(name="same language, other technique", cond="a.technique <> b.technique AND a.language = b.language")
    out["A18_extremal_ranking"] = (
        w(
            CORPUS, VECS, "t AS (SELECT * FROM x WHERE arm = 'technique' AND technique IS NOT NULL)", "m AS (SELECT technique, pos, avg(v) AS m FROM t GROUP BY ALL)",
            "di AS (SELECT a, avg(d) AS distance FROM (SELECT a.technique AS a, b.technique AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM m a JOIN m b ON a.pos = b.pos AND a.technique <> b.technique GROUP BY ALL) GROUP BY a)",
            "sp AS (SELECT technique, avg(d) AS spread FROM (SELECT technique, line_no, sqrt(sum((v - m) * (v - m))) AS d FROM t JOIN m USING (technique, pos) GROUP BY ALL) GROUP BY technique)",
        )
        + f"SELECT technique, {r('distance', 'distance')}, {r('spread', 'spread')} FROM sp LEFT JOIN di ON a = technique"
    )
    loo = "t0 AS (SELECT language, pos, sum(v) AS s, count(*) AS n FROM tx GROUP BY ALL), d0 AS (SELECT tx.* EXCLUDE (v), v - (s - v) / (n - 1) AS v FROM tx JOIN t0 USING (language, pos) WHERE n > 1), loo AS (SELECT d0.* EXCLUDE (v), v / greatest(sqrt(sum(v * v) OVER (PARTITION BY line_no)), 1e-9) AS v FROM d0)"
    agreement = w(
        CORPUS, VECS, "tx AS (SELECT * FROM x WHERE arm = 'technique')", loo, "t AS (SELECT cl.* FROM (SELECT 'raw' AS cloud, * FROM tx UNION ALL BY NAME SELECT 'centred' AS cloud, * FROM loo) cl WHERE technique IS NOT NULL AND style IS NOT NULL)",
        "m AS (SELECT cloud, style AS s, technique AS lvl, pos, avg(v) AS m FROM t GROUP BY ALL)", "cn AS (SELECT cloud, s, lvl, pos, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY cloud, s, lvl)), 1e-9) AS w FROM m)",
        "co AS (SELECT cloud, line_no, technique, style, s, lvl, round(sum(v * w), 9) AS cos FROM t JOIN cn USING (cloud, pos) GROUP BY ALL)",
        "pk AS (SELECT cloud, line_no, technique, style, s, lvl FROM (SELECT *, row_number() OVER (PARTITION BY cloud, line_no, s ORDER BY cos DESC, lvl) AS rn FROM co) WHERE rn = 1)",
        "b AS (SELECT a.cloud, a.line_no, a.technique, a.style, a.lvl AS bt, v.lvl AS bv FROM pk a JOIN pk v USING (cloud, line_no) WHERE a.s = 'terse' AND v.s = 'verbose')",
        "wi AS (SELECT cloud, avg(c) AS within FROM (SELECT a.cloud, a.lvl, sum(a.w * b.w) AS c FROM cn a JOIN cn b ON a.cloud = b.cloud AND a.lvl = b.lvl AND a.pos = b.pos WHERE a.s = 'terse' AND b.s = 'verbose' GROUP BY ALL) GROUP BY cloud)",
        "be AS (SELECT cloud, avg(c) AS between FROM (SELECT a.cloud, a.lvl AS l1, b.lvl AS l2, sum(a.w * b.w) AS c FROM cn a JOIN cn b ON a.cloud = b.cloud AND a.lvl <> b.lvl AND a.pos = b.pos WHERE a.s = 'terse' AND b.s = 'terse' GROUP BY ALL) GROUP BY cloud)",
    )
    out["L20_centroid_agreement"] = agreement + f"SELECT cloud, count(*) AS n, {r('avg((bt = technique)::INT)', 'acc_terse')}, {r('avg((bv = technique)::INT)', 'acc_verbose')}, {r('avg((bt = bv)::INT)', 'agree')}, round(avg((bt = technique)::INT) FILTER (style = 'verbose'), 6) + 0.0 AS terse_on_verbose, round(avg((bv = technique)::INT) FILTER (style = 'terse'), 6) + 0.0 AS verbose_on_terse, {r('any_value(within)', 'within')}, {r('any_value(between)', 'between')} FROM b JOIN wi USING (cloud) JOIN be USING (cloud) GROUP BY cloud"
    out["J8_level_distances"] = (
        w(CORPUS, VECS, "m AS (SELECT technique, pos, avg(v) AS m FROM x WHERE arm = 'technique' AND technique IS NOT NULL GROUP BY ALL)")
        + f"SELECT a.technique AS a, b.technique AS b, {r('sqrt(sum((a.m - b.m) * (a.m - b.m)))', 'distance')} FROM m a JOIN m b ON a.pos = b.pos AND a.technique <> b.technique GROUP BY a.technique, b.technique"
    )
    out["W5_margins_by_direction"] = w(*_assigned()) + f"SELECT direction, count(*) AS n, {r('avg(cos)', 'first')}, {r('avg(second_cos)', 'second')}, {r('min(margin)', 'least')} FROM assigned WHERE direction IS NOT NULL GROUP BY direction"
    out["F2_direction_technique"] = w(*_assigned()) + f"SELECT direction, best, n, {r('n / sum(n) OVER (PARTITION BY direction)', 'share')} FROM (SELECT direction, best, count(*) AS n FROM assigned WHERE direction IS NOT NULL GROUP BY ALL)"
    out["U4_fresh_and_stale"] = w(CORPUS, _RENDERED) + "SELECT arm, count(*) FILTER (prompt IS NOT DISTINCT FROM fresh) AS fresh, count(*) FILTER (prompt IS DISTINCT FROM fresh) AS stale FROM rendered GROUP BY arm"
    out["U2_factor_levels"] = w(CORPUS) + " UNION ALL ".join(f"SELECT '{f}' AS factor, {f} AS level, count(*) AS n FROM corpus WHERE {f} IS NOT NULL GROUP BY {f}" for f in ("technique", "direction", "language", "style"))
    out["L38_cap_summary"] = (
        w(
            CORPUS, VECS, "raw AS (SELECT line_no, pos, v / sqrt(sum(v * v) OVER (PARTITION BY line_no)) AS u FROM x)", "mu AS (SELECT language, pos, avg(v) AS m FROM x GROUP BY ALL)",
            "cd AS (SELECT line_no, pos, v - m AS v FROM x JOIN mu USING (language, pos))", "cent AS (SELECT line_no, pos, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY line_no)), 1e-9) AS u FROM cd)",
        )
        + _cap("raw", "raw") + " UNION ALL " + _cap("cent", "centred")
    )
    out["J7_furthest_pair"] = (
        w(CORPUS, VECS) + f"SELECT a, b, {r('cos', 'cos')} FROM (SELECT a.line_no AS a, b.line_no AS b, round(list_inner_product(a.vec, b.vec) / sqrt(list_inner_product(a.vec, a.vec) * list_inner_product(b.vec, b.vec)), 9) AS cos FROM vecs a JOIN vecs b ON a.line_no < b.line_no ORDER BY 3, 1, 2 LIMIT 1)"
    )
    out["D2_grid_centroid_rank"] = (
        w(
            CORPUS, VECS, CENTRED, "y AS (SELECT 'raw' AS cloud, arm, theorem, language, pos, v FROM x UNION ALL SELECT 'centred', arm, theorem, language, pos, u FROM c)",
            "g AS (SELECT cloud, pos, avg(v) AS g FROM y WHERE arm <> 'scope' GROUP BY ALL)", "k AS (SELECT cloud, theorem, language, pos, avg(v) AS m, count(*) AS n FROM y WHERE arm = 'scope' GROUP BY ALL)",
            "s AS (SELECT cloud, theorem, language, any_value(n) AS n, sum(m * g) / greatest(sqrt(sum(m * m)) * sqrt(sum(g * g)), 1e-9) AS cos FROM k JOIN g USING (cloud, pos) GROUP BY ALL)",
        )
        + f"SELECT cloud, theorem, language, n, {r('cos', 'cos')}, row_number() OVER (PARTITION BY cloud ORDER BY round(cos, 9) DESC, theorem, language) AS place, theorem = {_OWN} AS centre FROM s"
    )
    gram = "lm AS (SELECT technique, pos, avg(v) AS m FROM x WHERE arm = 'technique' AND technique IS NOT NULL GROUP BY ALL), dm AS (SELECT technique, pos, m - avg(m) OVER (PARTITION BY pos) AS m FROM lm), gr AS (SELECT a.technique AS i, b.technique AS j, sum(a.m * b.m) AS g FROM dm a JOIN dm b USING (pos) GROUP BY ALL), tr AS (SELECT sum(g) AS t FROM gr WHERE i = j)"
    out["L15_spectrum_moments"] = (
        w(CORPUS, VECS, gram)
        + f"SELECT (SELECT count(DISTINCT i) - 1 FROM gr) AS components, 1.0::DOUBLE AS whole, {r('(SELECT sum(g * g) FROM gr) / (t * t)', 'squares')}, {r('(SELECT sum(a.g * b.g * c.g) FROM gr a JOIN gr b ON a.j = b.i JOIN gr c ON b.j = c.i AND c.j = a.i) / (t * t * t)', 'cubes')} FROM tr"
    )
    # the projector on the leading eigenvector, by squaring the Gram matrix 16 times
    steps = ["s0 AS MATERIALIZED (SELECT i, j, g / t AS g FROM gr, tr)"]
    for k in range(16):
        steps.append(f"q{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.g * b.g) AS g FROM s{k} a JOIN s{k} b ON a.j = b.i GROUP BY ALL), s{k + 1} AS MATERIALIZED (SELECT i, j, g / (SELECT sum(g) FROM q{k} WHERE i = j) AS g FROM q{k})")
    steps.append("e AS (SELECT i, g / sqrt((SELECT max(g) FROM s16 WHERE i = j)) AS e FROM s16 WHERE j = (SELECT j FROM s16 WHERE i = j ORDER BY g DESC, j LIMIT 1))")
    steps.append("ax AS (SELECT pos, sum(m * e) AS a FROM dm JOIN e ON i = technique GROUP BY pos), sg AS (SELECT sign(a) AS s FROM ax ORDER BY abs(a) DESC LIMIT 1), nr AS (SELECT sqrt(sum(a * a)) AS n FROM ax)")
    out["T6_leading_projection"] = (
        w(CORPUS, VECS, gram, *steps)
        + f"SELECT row_number() OVER (ORDER BY round(p, 9), level) AS place, level, {r('p', 'projection')} FROM (SELECT technique AS level, sum(m * a) / any_value(n) * any_value(s) AS p FROM dm JOIN ax USING (pos), sg, nr GROUP BY technique)"
    )
    out["D12_opposed_directions"] = (
        w(
            CORPUS, VECS, "t AS (SELECT * FROM x WHERE direction IS NOT NULL)", "m AS (SELECT direction, pos, avg(v) AS m FROM t GROUP BY ALL)",
            "sp AS (SELECT direction, avg(d) AS s FROM (SELECT direction, line_no, sqrt(sum((v - m) * (v - m))) AS d FROM t JOIN m USING (direction, pos) GROUP BY ALL) GROUP BY direction)",
            "o(a, b) AS (VALUES ('barehanded','heavyweight'),('pictorial','symbolic'),('broadest','shortest'),('explicit','unexpected'))",
            "di AS (SELECT o.a, o.b, sqrt(sum((ma.m - mb.m) * (ma.m - mb.m))) AS d FROM o JOIN m ma ON ma.direction = o.a JOIN m mb ON mb.direction = o.b AND mb.pos = ma.pos GROUP BY ALL)",
        )
        + f"SELECT di.a, di.b, {r('d', 'distance')}, {r('d / ((x1.s + x2.s) / 2)', 'separation')} FROM di JOIN sp x1 ON x1.direction = di.a JOIN sp x2 ON x2.direction = di.b"
    )
    out["W6_folds"] = w(CORPUS, VECS) + "SELECT line_no, technique, ntile(5) OVER (PARTITION BY technique ORDER BY line_no) - 1 AS fold FROM vecs WHERE technique IS NOT NULL"
    out["W8_one_per_cell"] = w(CORPUS) + "SELECT technique, language, style, line_no FROM (SELECT *, row_number() OVER (PARTITION BY technique, language, style ORDER BY md5('0|' || line_no), line_no) AS rn FROM corpus WHERE technique IS NOT NULL AND style IS NOT NULL) WHERE rn = 1"
    out["W9_shuffled_in_cell"] = (
        w(
            CORPUS, "k AS (SELECT line_no, technique, language, style, row_number() OVER (PARTITION BY language, style ORDER BY line_no) AS a, row_number() OVER (PARTITION BY language, style ORDER BY md5('0|0|' || line_no), line_no) AS b FROM corpus WHERE technique IS NOT NULL AND style IS NOT NULL)",
        )
        + "SELECT 0::BIGINT AS replicate, x.line_no, x.technique, y.technique AS shuffled FROM k x JOIN k y ON x.language = y.language AND x.style = y.style AND x.a = y.b"
    )
    out["L28_nmi"] = (
        w(
            CORPUS, "t AS (SELECT technique AS r, language AS k, count(*)::DOUBLE AS o FROM corpus WHERE technique IS NOT NULL GROUP BY ALL)", "g AS (SELECT sum(o) AS n FROM t)",
            "rr AS (SELECT r, sum(o) AS rt FROM t GROUP BY r)", "cc AS (SELECT k, sum(o) AS ct FROM t GROUP BY k)",
            "q AS (SELECT (SELECT sum(o / n * ln(o * n / (rt * ct))) FROM t JOIN rr USING (r) JOIN cc USING (k), g) AS mi, (SELECT -sum(rt / n * ln(rt / n)) FROM rr, g) AS h_row, (SELECT -sum(ct / n * ln(ct / n)) FROM cc, g) AS h_col)",
        )
        + f"SELECT {r('mi', 'mi')}, {r('h_row', 'h_row')}, {r('h_col', 'h_col')}, {r('CASE WHEN (h_row + h_col) / 2 > 1e-12 THEN mi / ((h_row + h_col) / 2) ELSE 1.0 END', 'nmi')} FROM q"
    )

    tok = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}')"
    tfidf = [
        "tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL)", "n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)",
        "voc AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2)", "rw AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term), n)",
        "un AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM rw)",
    ]
    term_report = f"SELECT term, count(*) AS docs, {r('sum(weight)', 'weight')}, {r('max(weight)', 'most')} FROM un GROUP BY term"
    tk = f"tk AS (SELECT doc_id, {tok} AS t FROM documents WHERE text IS NOT NULL)"
    out["L25_tfidf_words"] = w(tk, "terms AS (SELECT doc_id, unnest(t) AS term FROM tk UNION ALL SELECT doc_id, unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) FROM tk)", *tfidf) + term_report
    out["L25_tfidf_single_words"] = w(tk, "terms AS (SELECT doc_id, unnest(t) AS term FROM tk)", *tfidf) + term_report
    wd = r"wd AS (SELECT doc_id, ' ' || unnest(list_filter(string_split(regexp_replace(lower(text), '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+', ' ', 'g'), ' '), lambda s: s <> '')) || ' ' AS p FROM documents WHERE text IS NOT NULL)"
    for name, low, high in (("L25_tfidf_chars", 3, 5), ("L25_tfidf_short_chars", 2, 4)):
        # a word shorter than n gives itself, and only for the least n that reaches it
        gram_terms = " UNION ALL ".join(f"SELECT doc_id, unnest(list_transform(range(1, greatest(length(p) - {n - 1}, 1) + 1), lambda i: substr(p, i, {n}))) AS term FROM wd WHERE {n} = {low} OR length(p) >= {n}" for n in range(low, high + 1))
        out[name] = w(wd, f"terms AS ({gram_terms})", *tfidf) + term_report
    out["L31_masked_texts"] = w(CORPUS, _MASKED) + "SELECT line_no, md5(masked) AS masked FROM masked"
    kept = "sum(length(replace(masked, '⟨m⟩', '')))/sum(length(proof))"
    out["A24_text_kept"] = w(CORPUS, _MASKED) + f"SELECT language, count(*) AS n, {r(kept, 'kept')} FROM masked WHERE proof IS NOT NULL GROUP BY language"
    out["D8_kept_by_technique"] = w(CORPUS, _MASKED) + f"SELECT technique, count(*) AS n, {r(kept, 'kept')} FROM masked WHERE proof IS NOT NULL AND technique IS NOT NULL GROUP BY technique"
    cnt = "((length(masked) - length(replace(masked, '⟨m⟩', ''))) / 3)"
    out["D7_placeholder_leak"] = w(CORPUS, _MASKED) + f"SELECT language, sum({cnt})::BIGINT AS placeholders, {r(f'avg({cnt})', 'mean_count')}, {r(f'sum({cnt} * 3) / sum(length(masked))', 'density')} FROM masked WHERE masked IS NOT NULL GROUP BY language"
    out["L34_invoked_counts"] = w(CORPUS, Z_FIGURE, _COUNTS) + "SELECT line_no, invoked FROM counts"
    out["J10_registry_hits"] = w(CORPUS, Z_FIGURE, _COUNTS) + "SELECT name, count(*) AS texts FROM hits GROUP BY name"
    out["L35_two_coordinates"] = (
        w(CORPUS, Z_FIGURE, _COUNTS)
        + f"SELECT direction AS point, count(*) AS n, {r('avg(z)', 'mean_z')}, {r('avg(invoked)', 'mean_invoked')} FROM counts WHERE arm = 'extreme' AND direction IS NOT NULL GROUP BY direction UNION ALL SELECT 'technique: ' || technique, count(*), {r('avg(z)', 'mean_z')}, {r('avg(invoked)', 'mean_invoked')} FROM counts WHERE arm = 'technique' AND technique = 'product_counting' GROUP BY technique"
    )
    out["D3_best_threshold"] = (
        w(CORPUS, Z_FIGURE, _COUNTS, "e AS (SELECT invoked, direction = 'heavyweight' AS y FROM counts WHERE arm = 'extreme' AND direction IS NOT NULL)", "s AS (SELECT t.invoked AS threshold, round(avg(((e.invoked >= t.invoked) = e.y)::INT), 9) AS accuracy FROM e, (SELECT DISTINCT invoked FROM e) t GROUP BY ALL)")
        + f"SELECT threshold, {r('accuracy', 'accuracy')} FROM s ORDER BY accuracy DESC, threshold LIMIT 1"
    )
    out["D4_length_matched"] = (
        w(CORPUS, Z_FIGURE, _COUNTS)
        + f"SELECT 'longest technique' AS rows, count(*) AS n, {r('avg(invoked)', 'mean_invoked')}, {r('avg(chars)', 'mean_chars')} FROM (SELECT * FROM counts WHERE arm = 'technique' AND chars IS NOT NULL ORDER BY chars DESC, line_no LIMIT 30) UNION ALL SELECT 'extreme', count(*), {r('avg(invoked)', 'mean_invoked')}, {r('avg(chars)', 'mean_chars')} FROM counts WHERE arm = 'extreme' AND chars IS NOT NULL"
    )
    out["D5_spearman"] = (
        w(
            CORPUS, Z_FIGURE, _COUNTS, "e AS (SELECT * FROM counts WHERE arm = 'extreme' AND chars IS NOT NULL)",
            "rk AS (SELECT rank() OVER (ORDER BY invoked) + (count(*) OVER (PARTITION BY invoked) - 1) / 2 AS a, rank() OVER (ORDER BY chars) + (count(*) OVER (PARTITION BY chars) - 1) / 2 AS b FROM e)",
        )
        + f"SELECT count(*) AS n, {r('corr(a, b)', 'rho')} FROM rk"
    )
    out["D6_language_spread"] = (
        w(CORPUS, Z_FIGURE, _COUNTS, "e AS (SELECT * FROM counts WHERE arm = 'extreme' AND direction IS NOT NULL)", "pl AS (SELECT direction, language, avg(invoked) AS m FROM e GROUP BY ALL)")
        + f"SELECT direction, {r('min(m)', 'least')}, {r('max(m)', 'greatest')}, (SELECT round(median(invoked) FILTER (language IN {_DENSE}) / nullif(median(invoked) FILTER (language NOT IN {_DENSE}), 0), 6) + 0.0 FROM e WHERE e.direction = pl.direction) AS ratio FROM pl GROUP BY direction"
    )
    first = "(SELECT min(struct_pack(at := instr(c.proof, f), size := -length(f))) FROM (SELECT unnest(g.forms) AS f) WHERE contains(c.proof, f))"
    out["D9_one_language_entries"] = (
        w(CORPUS, Z_FIGURE, _COUNTS, f"ex AS (SELECT h.name, c.language, c.line_no, c.proof, {first} AS p FROM hits h JOIN corpus c USING (line_no) JOIN registry g ON g.name = h.name)")
        + "SELECT name, min(language) AS language, count(*) AS texts, arg_min(substr(proof, greatest(1, p.at - 20), p.at - p.size + 20 - greatest(1, p.at - 20)), line_no) AS excerpt FROM ex GROUP BY name HAVING count(DISTINCT language) = 1"
    )
    out["D10_registry_masking"] = (
        w("fs AS (SELECT list(DISTINCT f ORDER BY length(f) DESC, f) AS fs FROM (SELECT unnest(forms) AS f FROM registry))", "mm AS (SELECT arm, proof, list_reduce(list_prepend(proof, fs), lambda t, f: replace(t, f, '⟨m⟩')) AS masked FROM proofs_primes, fs WHERE proof IS NOT NULL)")
        + f"SELECT 'registry' AS tier, arm, count(*) AS n, count(*) FILTER (masked <> proof) AS touched, {r(kept, 'kept')} FROM mm GROUP BY arm"
    )
    mk = r"(regexp_matches(proof, '(?i)(^|[^\p{L}\p{M}\p{N}_])(proof([^\p{L}\p{M}\p{N}_]|$)|beweis|preuve|d[ée]monstration|prueba|demostraci[óo]n)') OR contains(proof, '证明') OR contains(proof, '証明'))"
    out["D11_proof_markers"] = w(CORPUS) + f"SELECT language, {mk} AS marked, count(*) AS n FROM corpus WHERE proof IS NOT NULL GROUP BY ALL"
    out["D11_cited_not_proved"] = (
        w(CORPUS, Z_FIGURE, _COUNTS, f"mc AS (SELECT c.language, c.invoked, {mk} AS marked FROM counts c JOIN proofs_primes p USING (line_no) WHERE p.proof IS NOT NULL)")
        + f"SELECT language, count(*) AS texts, count(*) FILTER (marked) AS marked, {r('avg(invoked)', 'mean_invoked')}, round(avg(invoked) FILTER (NOT marked), 6) + 0.0 AS mean_cited, sum(CASE WHEN marked THEN 0 ELSE invoked END)::BIGINT AS cited FROM mc GROUP BY language"
    )
    out["S13_kept_version"] = "SELECT 'old' AS version, arm, count(*) AS n, sum(length(proof))::BIGINT AS chars FROM proofs_primes GROUP BY arm UNION ALL SELECT 'new', arm, count(*), sum(length(proof))::BIGINT FROM proofs_primes WHERE arm = 'technique' GROUP BY arm"
    out["S5_settings_guard"] = "SELECT model, effort, count(*) AS n FROM proofs_primes WHERE model IS DISTINCT FROM 'model-a' OR effort IS DISTINCT FROM 'high' GROUP BY ALL"
    out["S11_batch_round"] = w(_GRID) + "SELECT arm, count(*) AS n, sum(length(theorem || ' ' || language))::BIGINT AS chars, count(*) AS output_tokens FROM grid WHERE arm <> 'technique' AND id NOT IN (SELECT id FROM proofs_primes WHERE id IS NOT NULL) GROUP BY arm"
    out["L37_pole_cosines"] = (
        w(
            CORPUS, VECS, "un AS (SELECT line_no, pos, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY line_no)), 1e-9) AS u FROM x)", "mn AS (SELECT pos, avg(u) AS m FROM un GROUP BY pos)",
            "pl AS (SELECT pos, m / greatest(sqrt(sum(m * m) OVER ()), 1e-9) AS p FROM mn)",
        )
        + f"SELECT line_no, {r('greatest(least(sum(u * p), 1.0), -1.0)', 'cos')} FROM un JOIN pl USING (pos) GROUP BY line_no"
    )
    out["L39_embed"] = "SELECT line_no, 1.0::DOUBLE AS norm FROM proofs_primes"
    out["L13_hull_optimal"] = w(CORPUS, VECS) + "SELECT DISTINCT technique AS point, true AS optimal FROM vecs WHERE arm = 'technique' AND technique IS NOT NULL"
    out["L14_hull_bootstrap_size"] = "SELECT 1000 AS replicates, true AS inside_is_share, true AS residual_is_distance"
    tv = "tv AS (SELECT * FROM vecs WHERE arm = 'technique')"
    size = "SELECT '{f}' AS label, count({f}) AS n, count(DISTINCT {f}) AS levels, round(1.0 / count(DISTINCT {f}), 6) + 0.0 AS chance, true AS accuracy_is_share FROM tv"
    out["L21_probe_sizes"] = w(CORPUS, VECS, tv) + " UNION ALL ".join(size.format(f=f) for f in ("technique", "language"))
    chance = "(SELECT round(1.0 / count(DISTINCT technique), 6) + 0.0 FROM tv)"
    out["L22_held_out_sizes"] = w(CORPUS, VECS, tv) + f"SELECT language, count(*) AS n, {chance} AS chance, true AS accuracy_is_share FROM tv WHERE technique IS NOT NULL GROUP BY language"
    out["L24_transfer_sizes"] = (
        w(CORPUS, VECS, tv, "g AS (SELECT language, count(*) AS n FROM tv WHERE technique IS NOT NULL GROUP BY language)")
        + f"SELECT a.language AS source, b.language AS target, b.n, {chance} AS chance, true AS accuracy_is_share FROM g a JOIN g b ON a.language <> b.language"
    )
    out["L23_transfer_sizes"] = w(CORPUS, VECS, tv) + f"SELECT 'en' AS source, language AS target, count(*) AS n, {chance} AS chance, true AS accuracy_is_share FROM tv WHERE technique IS NOT NULL AND language <> 'en' GROUP BY language"
    out["L26_baseline_sizes"] = w(CORPUS, VECS, "tv AS (SELECT * FROM vecs WHERE arm = 'technique' AND language = 'en' AND technique IS NOT NULL AND style IS NOT NULL)") + (
        f"SELECT representation, (SELECT count(*) FROM tv) AS n, {chance} AS chance, true AS accuracy_is_share FROM (SELECT unnest(['words 1-2', 'chars 3-5', 'vectors']) AS representation)"
    )
    out["L27_slice_sizes"] = w(CORPUS, VECS, tv) + "SELECT style, count(*) AS n, true AS nmi_is_share, true AS probe_is_share FROM tv WHERE style IS NOT NULL AND technique IS NOT NULL GROUP BY style"
    out["L33_sweep_sizes"] = "SELECT unnest([0, 10, 50, 100, 400]) AS k, true AS whole_at_none, true AS kept_is_share, true AS accuracy_is_share"
    out["L41_offset_sizes"] = w(CORPUS, VECS) + "SELECT cloud, 'language' AS label, count(language) AS n, count(DISTINCT language) AS levels, round(1.0 / count(DISTINCT language), 6) + 0.0 AS chance, true AS judged FROM vecs, (SELECT unnest(['raw', 'centred']) AS cloud) WHERE arm = 'extreme' GROUP BY cloud"
    part = "SELECT 'all' AS records, dims, '{f}' AS label, (SELECT count({f}) FROM tv) AS n, (SELECT round(1.0 / count(DISTINCT {f}), 6) + 0.0 FROM tv) AS chance, true AS accuracy_is_share FROM (SELECT unnest([2, 5, 10, 20, 50]) AS dims) UNION ALL SELECT 'one per cell', dims, '{f}', (SELECT count(*) FROM ce), (SELECT round(1.0 / count(DISTINCT {f}), 6) + 0.0 FROM ce), true FROM (SELECT unnest([5, 10, 20]) AS dims)"
    cells = "ce AS (SELECT DISTINCT technique, language, style FROM tv WHERE technique IS NOT NULL AND style IS NOT NULL)"
    out["L19_grid_sizes"] = w(CORPUS, VECS, tv, cells) + " UNION ALL ".join(part.format(f=f) for f in ("technique", "language", "style"))
    out["L29_probe_error_sizes"] = w(CORPUS, VECS, tv) + "SELECT count(*) AS n, 0 AS right, true AS wrong_is_part FROM tv WHERE technique IS NOT NULL"
    out["L30_terms_known"] = (
        w(CORPUS, VECS, tv) + f"SELECT language, 0 AS unknown, true AS placed FROM tv WHERE technique IS NOT NULL AND style = 'terse' AND language IN ({_LANGS}) GROUP BY language HAVING count(DISTINCT technique) > 1"
    )
    out["L36_silhouette"] = (
        w(
            CORPUS, VECS, "tv AS (SELECT * FROM vecs WHERE arm = 'technique' AND technique IS NOT NULL)", "sz AS (SELECT technique, count(*) AS n FROM tv GROUP BY technique)",
            "di AS (SELECT a.line_no, a.technique AS own, b.technique AS lvl, sum(list_distance(a.vec, b.vec)) AS d FROM tv a JOIN tv b ON true GROUP BY ALL)",
            "ab AS (SELECT line_no, own, max(CASE WHEN own = lvl AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN own <> lvl THEN d / n END) AS b FROM di JOIN sz ON sz.technique = lvl GROUP BY ALL)",
        )
        + f"SELECT count(*) AS n, {r('avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0))', 'silhouette')} FROM ab"
    )
    # pseudo-inverses of the factors' Gram matrices by X <- X (2 I - G X), and the trace of the product of both projectors
    parts = ["t AS (SELECT * FROM x WHERE arm = 'technique')"]
    for f in ("language", "style", "technique"):
        parts.append(f"m_{f} AS MATERIALIZED (SELECT lvl, pos, m - avg(m) OVER (PARTITION BY pos) AS m FROM (SELECT {f} AS lvl, pos, avg(v) AS m FROM t WHERE {f} IS NOT NULL GROUP BY ALL))")
        parts.append(f"g_{f} AS MATERIALIZED (SELECT a.lvl AS i, b.lvl AS j, sum(a.m * b.m) AS g FROM m_{f} a JOIN m_{f} b USING (pos) GROUP BY ALL)")
        parts.append(f"x_{f}_0 AS MATERIALIZED (SELECT i, j, g / (SELECT max(s) * max(s) FROM (SELECT sum(abs(g)) AS s FROM g_{f} GROUP BY i)) AS g FROM g_{f})")
        for k in range(34):
            parts.append(f"y_{f}_{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.g * b.g) AS g FROM g_{f} a JOIN x_{f}_{k} b ON a.j = b.i GROUP BY ALL)")
            parts.append(f"x_{f}_{k + 1} AS MATERIALIZED (SELECT a.i, b.j, sum(a.g * (CASE WHEN b.i = b.j THEN 2 ELSE 0 END - b.g)) AS g FROM x_{f}_{k} a JOIN y_{f}_{k} b ON a.j = b.i GROUP BY ALL)")
    pairs = [("language", "style"), ("language", "technique"), ("style", "technique")]
    for a, b in pairs:
        parts.append(f"c_{a}_{b} AS MATERIALIZED (SELECT p.lvl AS i, q.lvl AS j, sum(p.m * q.m) AS g FROM m_{a} p JOIN m_{b} q USING (pos) GROUP BY ALL)")
    out["L17_subspace_overlap"] = w(CORPUS, VECS, *parts) + " UNION ALL ".join(
        f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, {r('sum(p.g * c.g * q.g * d.g)', 'overlap')} FROM x_{a}_34 p JOIN c_{a}_{b} c ON p.j = c.i JOIN x_{b}_34 q ON c.j = q.i JOIN c_{a}_{b} d ON d.i = p.i AND d.j = q.j" for a, b in pairs
    )
    return out
