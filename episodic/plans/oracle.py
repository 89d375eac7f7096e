"""DuckDB oracle SQL for every registered query (same column names, same rounding).

Views mirror ``episodic.sources.tables``.  DuckDB lists are 1-based.
"""

from __future__ import annotations

from episodic.functions.rand import u01_sql


def R(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"

STEPS = EV + """,
steps AS (
  SELECT 'ds' || CAST(user_id % 5 AS VARCHAR) AS dataset_name, user_id AS traj_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t,
         event_id, ts, event_type, value, k,
         [value, k / 10.0::DOUBLE, CAST(hour(ts) AS DOUBLE)] AS world_vector,
         [CAST(minute(ts) AS DOUBLE), CAST(second(ts) AS DOUBLE), 0.0::DOUBLE] AS rotation_delta,
         k / 100.0::DOUBLE AS gripper,
         CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'purchase' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS rel_gripper,
         [value, value * 0.5, CAST(k AS DOUBLE), CAST(hour(ts) AS DOUBLE), CAST(minute(ts) AS DOUBLE),
          CAST(second(ts) AS DOUBLE), k / 100.0::DOUBLE, value / 100.0::DOUBLE] AS state,
         CASE WHEN event_type = 'error' THEN '' ELSE 'img/' || CAST(event_id AS VARCHAR) END AS image,
         CASE WHEN user_id % 7 = 0 THEN '' ELSE 'Task ' || CAST(user_id % 10 AS VARCHAR) END AS language_instruction
  FROM ev),
steps_a AS MATERIALIZED (
  SELECT *, list_concat(world_vector, rotation_delta, [gripper]) AS action, state AS proprio,
         count(*) OVER (PARTITION BY dataset_name, traj_id) AS traj_len
  FROM steps)"""

# (dataset_name, traj_id, t, field, dim, x) over action (7) and proprio (8)
LONG = """,
long AS MATERIALIZED (
  SELECT dataset_name, traj_id, t, 'action' AS field, CAST(d.dim AS INTEGER) AS dim, action[d.dim + 1] AS x
  FROM steps_a, (SELECT unnest(range(0, 7)) AS dim) d
  UNION ALL
  SELECT dataset_name, traj_id, t, 'proprio' AS field, CAST(d.dim AS INTEGER) AS dim, proprio[d.dim + 1] AS x
  FROM steps_a, (SELECT unnest(range(0, 8)) AS dim) d)"""

STATS = """,
stats AS MATERIALIZED (
  SELECT dataset_name, field, dim, avg(x) AS mean, stddev_pop(x) AS std, max(x) AS max, min(x) AS min,
         quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99
  FROM long GROUP BY dataset_name, field, dim)"""


def norm_expr(kind: str, x: str = "l.x", st: str = "s", mask: str = "TRUE") -> str:
    if kind == "normal":
        return f"CASE WHEN {mask} THEN ({x} - {st}.mean) / ({st}.std + 1e-8) ELSE {x} END"
    lo, hi = ("min", "max") if kind == "bounds" else ("q01", "q99")
    clip = f"greatest(least(2 * ({x} - {st}.{lo}) / ({st}.{hi} - {st}.{lo} + 1e-8) - 1, 1.0), -1.0)"
    return f"CASE WHEN {st}.min = {st}.max THEN 0.0 WHEN {mask} THEN {clip} ELSE {x} END"


NORM_Q99 = """,
norm AS MATERIALIZED (
  SELECT l.dataset_name, l.traj_id, l.t, l.field, l.dim, """ + norm_expr("bounds_q99") + """ AS nx
  FROM long l JOIN stats s USING (dataset_name, field, dim))"""


ORACLE: dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn

    return deco


@oracle("steps_view")
def _():
    return "WITH " + STEPS + f"""
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, event_id, image, language_instruction,
       {R('gripper')} AS gripper, {R('rel_gripper')} AS rel_gripper, CAST(traj_len AS BIGINT) AS traj_len
FROM steps_a"""


@oracle("dataset_stats")
def _():
    return "WITH " + STEPS + LONG + STATS + f"""
SELECT dataset_name, field, dim, {R('mean')} AS mean, {R('std')} AS std, {R('max')} AS max, {R('min')} AS min,
       {R('q01')} AS q01, {R('q99')} AS q99
FROM stats"""


@oracle("dataset_counts")
def _():
    return "WITH " + STEPS + """
SELECT dataset_name, count(*) AS num_transitions, count(DISTINCT traj_id) AS num_trajectories
FROM steps_a GROUP BY dataset_name"""


def chunk_rows(keep: str = "") -> str:
    """Normalized chunks of six slots by one window pass, a row for every step, slot and dimension."""
    ahead = ", ".join(f"lead(nx, {k}, 0.0) OVER w" for k in range(1, 6))
    return "WITH " + STEPS + LONG + STATS + NORM_Q99 + f""",
ch AS (SELECT dataset_name, traj_id, t, dim, [nx, {ahead}] AS c FROM norm WHERE field = 'action'
       WINDOW w AS (PARTITION BY dataset_name, traj_id, dim ORDER BY t)),
ex AS (SELECT dataset_name, traj_id, t, dim, unnest(range(0, 6)) AS slot, unnest(c) AS v FROM ch)
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, CAST(slot AS BIGINT) AS slot, CAST(dim AS BIGINT) AS dim, {R('v')} AS value
FROM ex {keep}"""


ORACLE["normalize_chunk"] = chunk_rows()


W = "PARTITION BY dataset_name, traj_id"
WO = W + " ORDER BY t"


@oracle("binarize_gripper")
def _():
    dec = "CASE WHEN gripper > 0.95 THEN 1.0 WHEN gripper < 0.05 THEN 0.0 END"
    return "WITH " + STEPS + f"""
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t,
  {R(f"coalesce(first_value({dec} IGNORE NULLS) OVER ({WO} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(gripper) OVER ({WO} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")} AS value
FROM steps"""


@oracle("rel2abs_gripper")
def _():
    thr = "CASE WHEN rel_gripper < -0.1 THEN 1 WHEN rel_gripper > 0.1 THEN -1 END"
    return "WITH " + STEPS + f"""
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t,
  {R(f"coalesce(last_value({thr} IGNORE NULLS) OVER ({WO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -first_value({thr} IGNORE NULLS) OVER ({WO} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1) / 2.0 + 0.5")} AS value
FROM steps"""


@oracle("state_delta")
def _():
    return "WITH " + STEPS + f""",
nx AS (SELECT *, lead(state) OVER ({WO}) AS s2, list_concat(world_vector, rotation_delta, [gripper]) AS action FROM steps),
rel AS (SELECT dataset_name, traj_id, t, d.dim,
          CASE WHEN d.dim < 6 THEN s2[d.dim + 1] - state[d.dim + 1] ELSE action[7] END AS v
        FROM nx, (SELECT unnest(range(0, 7)) AS dim) d WHERE s2 IS NOT NULL)
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, CAST(dim AS BIGINT) AS dim, {R('v')} AS value FROM rel"""


@oracle("chunk_obs")
def _():
    return "WITH " + STEPS + """
SELECT a.dataset_name, a.traj_id, CAST(a.t AS BIGINT) AS t, CAST(sl.slot AS BIGINT) AS slot, b.image,
       (a.t - 2 + sl.slot) >= 0 AS pad_mask
FROM steps a, (SELECT unnest(range(0, 3)) AS slot) sl, steps b
WHERE b.dataset_name = a.dataset_name AND b.traj_id = a.traj_id AND b.t = greatest(a.t - 2 + sl.slot, 0)"""


@oracle("chunk_action_abs")
def _():
    return "WITH " + STEPS + """,
sa AS (SELECT *, list_concat(world_vector, rotation_delta, [gripper]) AS action,
              count(*) OVER (PARTITION BY dataset_name, traj_id) AS n FROM steps),
tg AS (SELECT a.dataset_name, a.traj_id, a.t, a.n, sl.slot, sl.slot - 1 AS off, d.dim
       FROM sa a, (SELECT unnest(range(0, 5)) AS slot) sl, (SELECT unnest(range(0, 7)) AS dim) d)
SELECT tg.dataset_name, tg.traj_id, CAST(tg.t AS BIGINT) AS t, CAST(tg.slot AS BIGINT) AS slot, CAST(tg.dim AS BIGINT) AS dim,
  """ + R("CASE WHEN tg.t + tg.off > tg.n - 1 THEN (CASE WHEN tg.dim = 6 THEN b.action[tg.dim + 1] ELSE 0.0 END) ELSE b.action[tg.dim + 1] END") + """ AS value
FROM tg JOIN sa b ON b.dataset_name = tg.dataset_name AND b.traj_id = tg.traj_id
 AND b.t = least(greatest(tg.t + tg.off, 0), tg.n - 1)"""


@oracle("pad_mask_dict")
def _():
    return "WITH " + STEPS + """
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, length(image) <> 0 AS image_mask,
       length(language_instruction) <> 0 AS language_mask, TRUE AS gripper_mask FROM steps"""


def _kept(where_having: str) -> str:
    return "WITH " + STEPS + f""",
keep AS (SELECT dataset_name, traj_id FROM steps GROUP BY dataset_name, traj_id HAVING {where_having})
SELECT s.dataset_name, s.traj_id, count(*) AS n_steps FROM steps s SEMI JOIN keep USING (dataset_name, traj_id)
GROUP BY s.dataset_name, s.traj_id"""


ORACLE["skip_unlabeled"] = _kept("bool_or(language_instruction <> '')")
ORACLE["max_action_filter"] = _kept(
    "bool_and(list_bool_and(list_transform(list_concat(world_vector, rotation_delta, [gripper]), lambda x: abs(x) <= 450.0)))")
ORACLE["max_proprio_filter"] = _kept("bool_and(list_bool_and(list_transform(state, lambda x: abs(x) <= 400.0)))")
ORACLE["drop_first_step"] = "WITH " + STEPS + """
SELECT dataset_name, traj_id, CAST(t - 1 AS BIGINT) AS t, event_id FROM steps WHERE t > 0"""
ORACLE["drop_last_step"] = "WITH " + STEPS + """
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, event_id FROM steps
QUALIFY t < count(*) OVER (PARTITION BY dataset_name, traj_id) - 1"""
ORACLE["traj_len"] = "WITH " + STEPS + """
SELECT dataset_name, traj_id, count(*) AS traj_len FROM steps GROUP BY ALL"""
ORACLE["any_all_reduce"] = "WITH " + STEPS + """
SELECT dataset_name, traj_id, bool_or(gripper > 0.95) AS any_open, bool_and(gripper > 0.01) AS all_above,
       bool_or(list_bool_or(list_transform(list_concat(world_vector, rotation_delta, [gripper]), lambda v: v > 400))) AS any_big,
       bool_and(list_bool_and(list_transform(state, lambda v: v >= 0))) AS all_nonneg
FROM steps GROUP BY ALL"""
ORACLE["chunk_filter"] = "WITH " + STEPS + """
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t FROM steps WHERE language_instruction <> ''"""


SEED = 7
GOAL = """,
g AS (SELECT dataset_name, traj_id, t, image, language_instruction, count(*) OVER (PARTITION BY dataset_name, traj_id) AS n,
        least(CAST(floor(""" + u01_sql(SEED, "dataset_name", "traj_id", "t") + """ * (count(*) OVER (PARTITION BY dataset_name, traj_id) - (t + 1)) + (t + 1)) AS INTEGER),
              CAST(count(*) OVER (PARTITION BY dataset_name, traj_id) - 1 AS INTEGER)) AS goal_t
      FROM steps),
gg AS (SELECT g.*, b.image AS goal_image FROM g JOIN steps b
       ON b.dataset_name = g.dataset_name AND b.traj_id = g.traj_id AND b.t = g.goal_t)"""


@oracle("goal_uniform")
def _():
    return "WITH " + STEPS + GOAL + """
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, CAST(goal_t AS BIGINT) AS goal_t, goal_image,
       length(goal_image) <> 0 AS goal_image_mask FROM gg"""


@oracle("delete_task_conditioning")
def _():
    keep = f"({u01_sql(SEED + 1, 'dataset_name', 'traj_id', 't')} < 0.5 OR length(language_instruction) = 0)"
    return "WITH " + STEPS + GOAL + f"""
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t,
       CAST(CASE WHEN {keep} THEN goal_t ELSE n - 1 END AS BIGINT) AS goal_t,
       CASE WHEN {keep} THEN goal_image ELSE '' END AS goal_image,
       CASE WHEN {keep} THEN '' ELSE language_instruction END AS language_instruction,
       {keep} AND length(goal_image) <> 0 AS goal_image_mask,
       NOT {keep} AND length(language_instruction) <> 0 AS language_mask
FROM gg"""


@oracle("subsample")
def _():
    return "WITH " + STEPS + f"""
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t FROM steps
QUALIFY count(*) OVER (PARTITION BY dataset_name, traj_id) <= 50
     OR row_number() OVER (PARTITION BY dataset_name, traj_id ORDER BY {u01_sql(SEED, 'dataset_name', 'traj_id', 't')}, t) <= 50"""


@oracle("split_train_val")
def _():
    return "WITH " + STEPS + """,
tr AS (SELECT DISTINCT dataset_name, traj_id FROM steps),
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY traj_id) - 1 AS r,
              count(*) OVER (PARTITION BY dataset_name) AS n FROM tr)
SELECT dataset_name, traj_id, CASE WHEN r < round(n * 0.95) THEN 'train' ELSE 'val' END AS split FROM rk"""


@oracle("shuffled_read")
def _():
    return "WITH " + STEPS + f""",
tr AS (SELECT DISTINCT dataset_name, traj_id FROM steps)
SELECT dataset_name, traj_id, row_number() OVER (ORDER BY {u01_sql(SEED, 'traj_id')}, traj_id) - 1 AS pos FROM tr"""


SHUF = f"""row_number() OVER (ORDER BY {u01_sql(SEED, 'traj_id', 't')}, traj_id, t) - 1"""


@oracle("shuffle_frames")
def _():
    return "WITH " + STEPS + f"""
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, {SHUF} AS pos FROM steps"""


@oracle("take_val")
def _():
    return "WITH " + STEPS + """
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, event_id FROM steps ORDER BY dataset_name, traj_id, t LIMIT 1000"""


@oracle("batch")
def _():
    return "WITH " + STEPS + f""",
p AS (SELECT traj_id, CAST(t AS BIGINT) AS t, {SHUF} AS pos FROM steps)
SELECT CAST(floor(pos / 16) AS BIGINT) AS batch, count(*) AS n_frames, arg_min(traj_id, pos) AS first_traj,
       arg_min(t, pos) AS first_t FROM p GROUP BY 1"""


@oracle("repeat")
def _():
    return "WITH " + STEPS + f""",
r AS (SELECT s.*, p.pass FROM steps s, (SELECT unnest(range(0, 2)) AS pass) p)
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, CAST(pass AS BIGINT) AS pass,
       CAST(floor({u01_sql(SEED, 'pass', 'traj_id', 't')} * 1000) AS BIGINT) AS draw FROM r"""


MIX = r"""mix AS (
  SELECT source AS dataset_name, count(*) AS size,
         CASE CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight,
         CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) AS pos
  FROM documents GROUP BY source),
mw AS (SELECT *, weight / sum(weight) OVER () AS sw, weight * size / sum(weight * size) OVER () AS bw FROM mix)"""

SPEC = """spec AS (
  SELECT lang AS mix, source AS dataset_name, 1.0 / (CASE WHEN n_chars < 2000 THEN 0 WHEN n_chars < 20000 THEN 1 ELSE 2 END + 1) AS weight,
         min(doc_id) AS pos
  FROM documents GROUP BY lang, source, CASE WHEN n_chars < 2000 THEN 0 WHEN n_chars < 20000 THEN 1 ELSE 2 END),
res AS (SELECT * FROM spec QUALIFY row_number() OVER (PARTITION BY mix, dataset_name ORDER BY pos) = 1)"""

ORACLE["mixture_weights"] = "WITH " + MIX + f"""
SELECT dataset_name, {R('sw')} AS w_plain, {R('bw')} AS w_balanced FROM mw"""
ORACLE["mixture_length"] = "WITH " + MIX + """
SELECT CAST(max(CASE WHEN weight = 1.0 THEN size / sw END) AS BIGINT) AS length_plain,
       CAST(max(CASE WHEN weight = 1.0 THEN size / bw END) AS BIGINT) AS length_balanced FROM mw"""
ORACLE["apportion"] = "WITH " + MIX + f""",
ln AS (SELECT CAST(max(CASE WHEN weight = 1.0 THEN size / sw END) AS BIGINT) AS n FROM mw),
a AS (SELECT dataset_name, pos, n, sw * n AS share, floor(sw * n) AS integral FROM mw, ln),
b AS (SELECT *, share - integral AS frac, n - sum(integral) OVER () AS rest,
             row_number() OVER (ORDER BY share - integral DESC, pos DESC) AS rk FROM a)
SELECT dataset_name, CAST(integral + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b"""

CDF = """,
cdf AS (SELECT dataset_name, pos, sum(sw) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
               row_number() OVER (ORDER BY pos) - 1 AS idx FROM mw),
dlen AS (SELECT CAST(max(CASE WHEN weight = 1.0 THEN size / sw END) AS BIGINT) AS n FROM mw),
draws AS (SELECT r.draw, """ + u01_sql(SEED, "r.draw") + """ AS u FROM dlen, (SELECT unnest(range(0, (SELECT n FROM dlen))) AS draw) r),
dd AS (SELECT draws.draw, least((SELECT count(*) FROM cdf WHERE cdf.hi <= draws.u), (SELECT count(*) FROM cdf) - 1) AS idx FROM draws),
dds AS (SELECT dd.draw, cdf.dataset_name FROM dd JOIN cdf USING (idx))"""

ORACLE["draw_to_dataset"] = "WITH " + MIX + CDF + """
SELECT draw, dataset_name FROM dds"""
ORACLE["mixture_draws"] = "WITH " + MIX + CDF + """,
dk AS (SELECT draw, dataset_name, row_number() OVER (PARTITION BY dataset_name ORDER BY draw) - 1 AS k FROM dds),
fr AS (SELECT doc_id, source AS dataset_name, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS fi,
              count(*) OVER (PARTITION BY source) AS size FROM documents)
SELECT dk.draw, dk.dataset_name, fr.doc_id FROM dk JOIN fr ON fr.dataset_name = dk.dataset_name AND fr.fi = dk.k % fr.size"""
ORACLE["mixture_quota"] = "WITH " + MIX + f""",
ln AS (SELECT CAST(max(CASE WHEN weight = 1.0 THEN size / sw END) AS BIGINT) AS n FROM mw),
a AS (SELECT dataset_name, pos, n, sw * n AS share, floor(sw * n) AS integral FROM mw, ln),
b AS (SELECT *, n - sum(integral) OVER () AS rest, row_number() OVER (ORDER BY share - integral DESC, pos DESC) AS rk FROM a),
q AS (SELECT dataset_name, CAST(integral + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b),
fr AS (SELECT doc_id, source AS dataset_name,
              row_number() OVER (PARTITION BY source ORDER BY {u01_sql(SEED, 'doc_id')}, doc_id) - 1 AS r,
              count(*) OVER (PARTITION BY source) AS size FROM documents),
c AS (SELECT fr.dataset_name, fr.doc_id, CAST(floor(q.quota / fr.size) + CASE WHEN fr.r < q.quota % fr.size THEN 1 ELSE 0 END AS BIGINT) AS copies
      FROM fr JOIN q USING (dataset_name))
SELECT * FROM c WHERE copies > 0"""
ORACLE["resolve_mixture"] = "WITH " + SPEC + f"""
SELECT mix, dataset_name, {R('weight')} AS weight, CAST(pos AS BIGINT) AS pos FROM res WHERE dataset_name <> 'src19'"""
ORACLE["registry_join"] = "WITH " + MIX + ", " + SPEC + f"""
SELECT res.mix, res.dataset_name, {R('res.weight')} AS weight, mix.size FROM res JOIN mix USING (dataset_name)"""
ORACLE["registry_anti"] = """WITH n AS (
  SELECT concat_ws('/', source, lang, CAST(n_chars % 7 AS VARCHAR)) AS name, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents),
c AS (SELECT DISTINCT name FROM n WHERE NOT labelled), f AS (SELECT DISTINCT name FROM n WHERE labelled)
SELECT name, 'config_only' AS side FROM c ANTI JOIN f USING (name)
UNION ALL SELECT name, 'function_only' AS side FROM f ANTI JOIN c USING (name)"""
ORACLE["mixture_report"] = "WITH " + MIX + f"""
SELECT dataset_name, {R('round(sw, 6)')} AS weight, CAST(pos AS BIGINT) AS pos FROM mw"""
ORACLE["union_datasets"] = "WITH " + STEPS + """,
u AS (SELECT dataset_name, 7 AS dims FROM steps UNION ALL SELECT 'v' || CAST(label AS VARCHAR), len(embedding) FROM embeddings)
SELECT dataset_name, count(*) AS n, CAST(max(dims) AS BIGINT) AS dims FROM u GROUP BY ALL"""
ORACLE["key_difference"] = """
SELECT conv_id, array_to_string(list_sort(list_filter(['assistant', 'system', 'user'], lambda r: NOT list_contains(present, r))), ',') AS missing
FROM (SELECT conv_id, list(DISTINCT role) AS present FROM conversations GROUP BY conv_id)"""
ORACLE["views_check"] = """
SELECT dataset_name, array_to_string(list_sort(list_filter(['de', 'en', 'es', 'fr', 'it'], lambda r: NOT list_contains(views, r))), ',') AS missing_views
FROM (SELECT source AS dataset_name, list(DISTINCT lang) AS views FROM documents GROUP BY source)"""


DIALOGUE = """pr AS (SELECT conv_id, turn, role, text, coalesce(sum(CAST(role = 'assistant' AS INTEGER)) OVER (
             PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM conversations),
sg AS (SELECT conv_id, seg, min(turn) AS turn, coalesce(max(text) FILTER (role = 'assistant'), '') AS assistant,
              coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY turn) FILTER (role <> 'assistant'), '') AS utext FROM pr GROUP BY conv_id, seg),
pairs AS (SELECT conv_id, turn, assistant, utext,
             './audio/' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) || '.wav' AS path,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx,
             count(*) OVER (PARTITION BY conv_id) AS np
          FROM sg),
dlg AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN arg_max(assistant, turn) ELSE '' END AS response,
            'img/' || CAST(conv_id AS VARCHAR) AS image, 'img/' || CAST(conv_id AS VARCHAR) || '_0' AS first_frame_image,
            string_agg('<robot_action_' || CAST(length(assistant) % 2048 AS VARCHAR) || '>', '' ORDER BY turn) AS act_text,
            max(np) AS np,
            string_agg('[USER]' || utext || '[ASSISTANT]' || assistant, '[UNK]' ORDER BY turn) AS conversation,
            string_agg(path, '[UNK]' ORDER BY turn) AS speech_conv
        FROM pairs GROUP BY conv_id)"""

ORACLE["parse_conversation"] = "WITH " + DIALOGUE + """
SELECT conv_id, CAST(idx AS BIGINT) AS idx, assistant, regexp_replace(path, '^[./]+', '') AS audio FROM pairs"""

ORACLE["build_messages"] = "WITH " + DIALOGUE + """,
m AS (SELECT conv_id, min(idx) AS midx FROM (SELECT p.conv_id, p.idx FROM pairs p JOIN dlg d USING (conv_id)
      WHERE d.response <> '' AND p.assistant = d.response) GROUP BY conv_id),
sel AS (SELECT p.*, d.response, d.first_frame_image FROM pairs p JOIN dlg d USING (conv_id) LEFT JOIN m USING (conv_id)
        WHERE d.response = '' OR p.idx <= m.midx),
msgs AS (
  SELECT conv_id, 2 * idx AS msg_idx, 'user' AS role, 0 AS item_idx, 'image' AS type, first_frame_image AS value FROM sel
  UNION ALL SELECT conv_id, 2 * idx, 'user', 1, 'audio', regexp_replace(path, '^[./]+', '') FROM sel
  UNION ALL SELECT conv_id, 2 * idx + 1, 'assistant', 0, 'text', assistant FROM sel
  UNION ALL SELECT conv_id, 2 * np, 'user', 0, 'image', image FROM dlg WHERE response = ''
  UNION ALL SELECT conv_id, 2 * np + 1, 'assistant', 0, 'text', act_text FROM dlg WHERE response = '')
SELECT conv_id, CAST(msg_idx AS BIGINT) AS msg_idx, role, CAST(item_idx AS BIGINT) AS item_idx, type, value FROM msgs"""

TOKENS = """,
tk AS (SELECT traj_id, t, CAST(floor(t / 32) AS BIGINT) AS blk, 151665 + CAST(state[3] AS BIGINT) AS id FROM steps),
sq AS (SELECT traj_id * 4294967296 + blk AS seq_id, blk, list(id ORDER BY t) AS ids, CAST(floor(count(*) / 2) AS BIGINT) AS half
       FROM tk GROUP BY traj_id, blk),
tokens AS (SELECT seq_id, CASE WHEN seq_id % 4 = 0 THEN list_concat(ids, [151645, 151643, 151643])
        ELSE list_concat([151644, 77091, 198],
                         CASE WHEN blk % 2 = 1 THEN list_concat(ids[1:half], [151644, 77091, 198], ids[half + 1:]) ELSE ids END,
                         [151645, 151643, 151643]) END AS input_ids, 151643 AS pad_id FROM sq)"""

ORACLE["label_mask"] = "WITH " + STEPS + TOKENS + """,
mk AS (SELECT seq_id, max(j) AS lastj FROM (SELECT seq_id, input_ids, unnest(range(0, greatest(len(input_ids) - 5, 0))) AS j FROM tokens)
       WHERE input_ids[j + 1] = 151644 AND input_ids[j + 2] = 77091 AND input_ids[j + 3] = 198 GROUP BY seq_id),
ex AS (SELECT t.seq_id, t.pad_id, len(t.input_ids) AS n, coalesce(mk.lastj + 3, len(t.input_ids)) AS b,
              unnest(t.input_ids) AS x, unnest(range(0, len(t.input_ids))) AS pos FROM tokens t LEFT JOIN mk USING (seq_id))
SELECT seq_id, CAST(pos AS BIGINT) AS pos, CAST(CASE WHEN pos >= b AND x <> pad_id THEN x ELSE -100 END AS BIGINT) AS label FROM ex"""

ORACLE["token_range"] = "WITH " + STEPS + TOKENS + """,
k AS (SELECT seq_id, list_transform(list_filter(input_ids, lambda x: x >= 151665 AND x <= 153712), lambda x: x - 151665) AS act FROM tokens)
SELECT seq_id, CAST(len(act) AS BIGINT) AS n_kept, CAST(act[1] AS BIGINT) AS first_id,
       array_to_string(list_transform(act, lambda x: '<robot_action_' || CAST(x AS VARCHAR) || '>'), '') AS action_text FROM k"""

ORACLE["act_mode"] = """WITH a AS (
  SELECT conv_id, turn, text || CASE WHEN length(text) % 5 = 0 THEN ' [ACT]' ELSE '' END AS text
  FROM conversations WHERE role = 'assistant'),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nb FROM a),
c AS (SELECT *, coalesce(max(CAST(contains(text, '[ACT]') OR nb + 1 >= 3 AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS sw FROM b)
SELECT conv_id, turn, CASE WHEN sw THEN 'action' ELSE 'dialogue' END AS mode,
       CASE WHEN sw THEN NULL WHEN contains(text, '[ACT]') THEN text WHEN nb + 1 >= 3 THEN text || ' [ACT]' ELSE text END AS reply,
       contains(text, '[ACT]') AS has_act FROM c"""

CATALOG = """,
items AS (SELECT d.conv_id, 'Task ' || CAST(d.conv_id % 10 AS VARCHAR) AS instruction, d.np,
                 (SELECT arg_min(assistant, idx) FROM pairs p WHERE p.conv_id = d.conv_id) AS first_response,
                 (SELECT arg_max(assistant, idx) FROM pairs p WHERE p.conv_id = d.conv_id) AS last_response FROM dlg d),
cat AS (SELECT instruction, arg_max(np, conv_id) AS n_speech, arg_max(first_response, conv_id) AS first_response,
               arg_max(last_response, conv_id) AS last_response FROM items GROUP BY instruction)"""

ORACLE["instruction_catalog"] = "WITH " + DIALOGUE + CATALOG + """
SELECT instruction, CAST(n_speech AS BIGINT) AS n_speech, first_response, last_response FROM cat"""

ORACLE["attach_dialogue"] = "WITH " + DIALOGUE + CATALOG + ", " + STEPS + """
SELECT s.dataset_name, s.traj_id, CAST(s.t AS BIGINT) AS t, s.language_instruction AS task, CAST(c.n_speech AS BIGINT) AS n_conv
FROM steps s LEFT JOIN cat c ON c.instruction = s.language_instruction AND s.language_instruction <> ''"""


RO = "ro AS (SELECT event_type AS task, event_id AS episode, value > 50 AS success FROM events)"
ORACLE["success_rate"] = "WITH " + RO + f"""
SELECT coalesce(task, '__total__') AS task, count(*) AS episodes, CAST(sum(CAST(success AS BIGINT)) AS BIGINT) AS successes,
       {R('avg(CAST(success AS DOUBLE))')} AS rate FROM ro GROUP BY ROLLUP (task)"""
ORACLE["running_success"] = "WITH " + RO + f""",
c AS (SELECT task, episode,
        count(*) OVER (PARTITION BY task ORDER BY episode ROWS UNBOUNDED PRECEDING) AS te,
        sum(CAST(success AS BIGINT)) OVER (PARTITION BY task ORDER BY episode ROWS UNBOUNDED PRECEDING) AS ts,
        count(*) OVER (ORDER BY episode ROWS UNBOUNDED PRECEDING) AS ae,
        sum(CAST(success AS BIGINT)) OVER (ORDER BY episode ROWS UNBOUNDED PRECEDING) AS as_ FROM ro)
SELECT task, episode, CAST(te AS BIGINT) AS task_episodes, CAST(ts AS BIGINT) AS task_successes, {R('ts / te')} AS task_rate,
       CAST(ae AS BIGINT) AS total_episodes, CAST(as_ AS BIGINT) AS total_successes, {R('as_ / ae')} AS total_rate FROM c"""
ORACLE["interval_loss"] = f"""WITH m AS (SELECT event_id + 1 AS step, value AS loss FROM events),
g AS (SELECT CAST(ceil(step / 100) AS BIGINT) AS i, sum(loss) AS s, max(step) AS mx FROM m GROUP BY 1)
SELECT CAST(i * 100 AS BIGINT) AS steps, {R('s / 100.0')} AS train_loss FROM g WHERE mx >= i * 100"""
ORACLE["append_summary"] = ORACLE["interval_loss"]
ORACLE["latest_step"] = r"""WITH n AS (
  SELECT o_custkey AS run, 'steps_' || CAST(o_orderkey AS VARCHAR) AS name FROM orders
  UNION ALL SELECT o_custkey, 'other_' || CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT o_custkey, 'steps_' || CAST(o_orderkey AS VARCHAR) || 'x' FROM orders),
k AS (SELECT run, name, CAST(regexp_extract(name, '^steps_(\d+)$', 1) AS BIGINT) AS n FROM n WHERE regexp_full_match(name, 'steps_\d+'))
SELECT run, arg_max(name, n) AS latest, max(n) AS latest_step, count(*) AS n_checkpoints FROM k GROUP BY run"""
ORACLE["unnormalize"] = "WITH " + STEPS + LONG + STATS + NORM_Q99 + f"""
SELECT n.dataset_name, n.traj_id, CAST(n.t AS BIGINT) AS t, CAST(n.dim AS BIGINT) AS dim,
       {R('0.5 * (n.nx + 1) * (s.q99 - s.q01) + s.q01')} AS value
FROM norm n JOIN stats s USING (dataset_name, field, dim) WHERE n.field = 'action'"""
ORACLE["gripper_postprocess"] = "WITH " + STEPS + f""",
g AS (SELECT dataset_name, traj_id, t, gripper AS x, sign(2 * gripper - 1) AS b FROM steps)
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, {R('2 * x - 1')} AS g_pm1, {R('b')} AS g_bin, {R('-b')} AS g_flip,
       {R('CASE WHEN -b >= 0 THEN 1.0 ELSE -b END')} AS g_snap, {R('1 - greatest(least(x, 1.0), 0.0)')} AS g_inv FROM g"""
ORACLE["write_rollouts"] = "WITH " + STEPS + f"""
SELECT dataset_name AS task, traj_id AS episode, count(*) AS n_steps, {R('sum(world_vector[1])')} AS sum_a0 FROM steps GROUP BY ALL"""


# ----------------------------------------------------------------------------- standardizers
Z = "0.0::DOUBLE"
RAW = """,
raw0 AS (SELECT *, list_concat(world_vector, rotation_delta, [gripper]) AS action,
                [state[3] / 100.0, state[4] / 24.0, state[5] / 60.0, 1.0::DOUBLE] AS qraw FROM steps),
raw AS (SELECT dataset_name, traj_id, t, world_vector, rotation_delta, state, action, language_instruction,
           gripper > 0.5 AS open_gripper, rel_gripper AS gca,
           list_concat(action[1:6], [rel_gripper * 1.5]) AS rel_actions, state AS robot_obs,
           [state[1] / 100.0, state[3] / 100.0] AS action2,
           list_concat(world_vector,
             list_transform(qraw, lambda q: q / sqrt(qraw[1] * qraw[1] + qraw[2] * qraw[2] + qraw[3] * qraw[3] + qraw[4] * qraw[4])),
             [gripper]) AS action_quat,
           [state[1] / 100.0, state[1] / 200.0] AS position, [state[6] / 60.0] AS yaw,
           [state[1] / 100.0, state[3] / 1000.0, state[4] / 100.0, state[5] / 600.0, state[6] / 600.0, state[3] / 500.0] AS cv,
           [state[3] / 100.0, state[4] / 24.0, state[5] / 60.0, state[6] / 60.0 * 3.14, state[3] / 200.0, state[4] / 48.0] AS cp,
           [gripper] AS gpos
        FROM raw0)"""


def std_out(cte: str, proprio: bool) -> str:
    parts = [f"SELECT dataset_name, traj_id, t, 'action' AS field, unnest(range(0, len(action))) AS dim, unnest(action) AS v FROM {cte}"]
    if proprio:
        parts.append(f"SELECT dataset_name, traj_id, t, 'proprio' AS field, unnest(range(0, len(proprio))) AS dim, unnest(proprio) AS v FROM {cte}")
    body = " UNION ALL ".join(parts)
    return f"""
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, field, CAST(dim AS BIGINT) AS dim, {R('v')} AS value FROM ({body})"""


def _std(body: str, proprio: bool) -> str:
    return "WITH " + STEPS + RAW + ",\nout AS (" + body + ")" + std_out("out", proprio)


W6 = ("coalesce(first_value(CASE WHEN g > 0.95 THEN 1.0 WHEN g < 0.05 THEN 0.0 END IGNORE NULLS) OVER "
      "(PARTITION BY dataset_name, traj_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
      "last_value(g) OVER (PARTITION BY dataset_name, traj_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")
W7 = ("(coalesce(last_value(CASE WHEN gca < -0.1 THEN 1 WHEN gca > 0.1 THEN -1 END IGNORE NULLS) OVER "
      "(PARTITION BY dataset_name, traj_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
      "-first_value(CASE WHEN gca < -0.1 THEN 1 WHEN gca > 0.1 THEN -1 END IGNORE NULLS) OVER "
      "(PARTITION BY dataset_name, traj_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1) / 2.0 + 0.5)")
DELTA = "[" + ", ".join(f"s2[{i}] - state[{i}]" for i in range(1, 7)) + "]"


def clip01(x: str) -> str:
    return f"greatest(least({x}, 1.0), 0.0)"


def _bridge(first_action: str) -> str:
    return f"""SELECT dataset_name, traj_id, t, list_concat({DELTA}, [a0[7]]) AS action, list_concat(state[1:6], [state[8]]) AS proprio
  FROM (SELECT *, lead(state) OVER (PARTITION BY dataset_name, traj_id ORDER BY t) AS s2
        FROM (SELECT dataset_name, traj_id, t, state, {first_action} AS a0
              FROM (SELECT *, t - 1 AS t0, action[7] AS g FROM raw WHERE t > 0) b0x
              ) b1) b2
  WHERE s2 IS NOT NULL"""


# Rotations, by other ways than the operators': elementary matrices multiplied one by one, angles
# straight from the quaternion.
def mm(p: str, q: str) -> str:
    """Product of two 3 x 3 matrices, lists of nine by rows."""
    return "[" + ", ".join(" + ".join(f"{p}[{3 * i + k + 1}] * {q}[{3 * k + j + 1}]" for k in range(3)) for i in range(3) for j in range(3)) + "]"


def mv(p: str, v: str) -> str:
    return "[" + ", ".join(" + ".join(f"{p}[{3 * i + k + 1}] * {v}[{k + 1}]" for k in range(3)) for i in range(3)) + "]"


def turn_x(a: str) -> str:
    return f"[1.0::DOUBLE, 0, 0, 0, cos({a}), -sin({a}), 0, sin({a}), cos({a})]"


def turn_y(a: str) -> str:
    return f"[cos({a}), 0, sin({a}), 0, 1.0::DOUBLE, 0, -sin({a}), 0, cos({a})]"


def turn_z(a: str) -> str:
    return f"[cos({a}), -sin({a}), 0, sin({a}), cos({a}), 0, 0, 0, 1.0::DOUBLE]"


_X, _Y, _Z, _W = (f"action_quat[{k}]" for k in (4, 5, 6, 7))
QUAT_EULER = (f"[atan2(2 * ({_W} * {_X} + {_Y} * {_Z}), 1 - 2 * ({_X} * {_X} + {_Y} * {_Y})), asin(greatest(least(2 * ({_W} * {_Y} - {_Z} * {_X}), 1.0), -1.0)), "
              f"atan2(2 * ({_W} * {_Z} + {_X} * {_Y}), 1 - 2 * ({_Y} * {_Y} + {_Z} * {_Z}))]")
#: raw with the wrist-frame velocity: first turned back about z, then y, then x
WRIST_RAW = f"""(SELECT *, list_concat({mv('bx', 'v2')}, ({mm('ri', 'dr')})[1:6]) AS wrist FROM (
  SELECT *, {mm('dv', 'r')} AS dr, {mv('byb', 'v1')} AS v2 FROM (
    SELECT *, {mm('zy', 'fx')} AS r, {mm('bxy', 'bz')} AS ri, {mm('dzy', 'dx')} AS dv, {mv('bz', 'cv[1:3]')} AS v1 FROM (
      SELECT *, {mm('fz', 'fy')} AS zy, {mm('bx', 'byb')} AS bxy, {mm('dz', 'dy')} AS dzy FROM (
        SELECT *, {turn_x('cp[4]')} AS fx, {turn_y('cp[5]')} AS fy, {turn_z('cp[6]')} AS fz, {turn_x('-cp[4]')} AS bx, {turn_y('-cp[5]')} AS byb, {turn_z('-cp[6]')} AS bz,
               {turn_x('cv[4]')} AS dx, {turn_y('cv[5]')} AS dy, {turn_z('cv[6]')} AS dz FROM raw)))))"""

ORACLE["std_bridge_oxe"] = _std(_bridge("list_concat(world_vector, rotation_delta, [CAST(open_gripper AS DOUBLE)])").replace(
    "SELECT dataset_name, traj_id, t, state,", "SELECT dataset_name, traj_id, t0 AS t, state,"), True)
ORACLE["std_bridge_orig"] = _std(_bridge(f"list_concat(action[1:6], [{W6.replace('ORDER BY t', 'ORDER BY t0')}])").replace(
    "SELECT dataset_name, traj_id, t, state,", "SELECT dataset_name, traj_id, t0 AS t, state,"), True)
ORACLE["std_rt1"] = _std(f"SELECT dataset_name, traj_id, t, list_concat(world_vector, rotation_delta, [{W7}]) AS action FROM raw", False)
ORACLE["std_taco"] = _std(f"""SELECT dataset_name, traj_id, t, list_concat(rel_actions[1:6], [{clip01('rel_actions[7]')}]) AS action,
  list_concat(robot_obs[1:6], [robot_obs[8]]) AS proprio FROM raw""", True)
ORACLE["std_jaco"] = _std(f"SELECT dataset_name, traj_id, t, list_concat(world_vector, [{Z}, {Z}, {Z}], [{W7}]) AS action FROM raw", False)
ORACLE["std_roboturk"] = _std(f"SELECT dataset_name, traj_id, t, list_concat(world_vector, rotation_delta, [1 - {clip01('gca')}]) AS action FROM raw", False)
ORACLE["std_language_table"] = _std(f"SELECT dataset_name, traj_id, t, list_concat(action2, [{Z}, {Z}, {Z}, {Z}], [1.0::DOUBLE]) AS action FROM raw", False)
ORACLE["std_hydra"] = _std("""SELECT dataset_name, traj_id, t, list_concat(action[1:6], [1 - action[7]]) AS action,
  list_concat(state[1:3], [state[8]], [state[6]]) AS proprio FROM raw""", True)
ORACLE["std_furniture"] = _std(f"""SELECT dataset_name, traj_id, t, list_concat(action_quat[1:3], {QUAT_EULER}, [1 - {clip01('action_quat[8]')}]) AS action,
  list_concat(state[1:7], [state[8]]) AS proprio FROM raw""", True)
ORACLE["std_stretch"] = _std(f"""SELECT dataset_name, traj_id, t, action[1:6] AS action,
  list_concat(state[1:3], [{Z}, {Z}, {Z}], [state[8]]) AS proprio FROM raw""", True)
ORACLE["std_gnm"] = _std(f"""SELECT dataset_name, traj_id, t, list_concat(action2, [{Z}, {Z}, {Z}, {Z}, {Z}]) AS action,
  list_concat(position, [{Z}, {Z}, {Z}], yaw) AS proprio FROM raw""", True)
ORACLE["std_libero"] = _std(f"""SELECT dataset_name, traj_id, t, list_concat(action[1:6], [1 - {clip01('action[7]')}]) AS action,
  list_concat(state[1:6], state[7:8]) AS proprio FROM raw""", True)
ORACLE["std_droid_wrist"] = _std(f"""SELECT dataset_name, traj_id, t, list_concat(wrist, gpos) AS action,
  list_concat(cp, gpos) AS proprio FROM {WRIST_RAW}""", True)
ORACLE["std_fanuc"] = _std("""SELECT dataset_name, traj_id, t, list_concat(action[1:6], [1 - state[7]]) AS action,
  list_concat(state[1:6], [state[7]]) AS proprio FROM raw""", True)
ORACLE["std_playfusion"] = _std("SELECT dataset_name, traj_id, t, list_concat(action_quat[1:3], action_quat[5:8]) AS action FROM raw", False)
ORACLE["std_robo_net"] = _std(f"""SELECT dataset_name, traj_id, t, list_concat(action[1:4], [{Z}, {Z}], [action[7]]) AS action,
  list_concat(state[1:4], [{Z}, {Z}], [state[8]]) AS proprio FROM raw""", True)
ORACLE["codepoints_to_text"] = "WITH " + STEPS + """
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, language_instruction FROM steps"""


ORACLE["stream_normalize"] = "WITH " + STEPS + LONG.replace("SELECT dataset_name, traj_id, t,", "SELECT dataset_name, traj_id, t, event_id,") + STATS + f"""
SELECT l.dataset_name, l.traj_id, l.event_id, CAST(l.dim AS BIGINT) AS dim, {R(norm_expr('bounds_q99'))} AS value
FROM long l JOIN stats s USING (dataset_name, field, dim) WHERE l.field = 'action'"""
ORACLE["stream_success"] = "WITH " + RO + f"""
SELECT task, count(*) AS episodes, CAST(sum(CAST(success AS BIGINT)) AS BIGINT) AS successes,
       {R('sum(CAST(success AS BIGINT)) / count(*)')} AS rate FROM ro GROUP BY task"""
ORACLE["stream_act_mode"] = ORACLE["act_mode"].replace(",\n       contains(text, '[ACT]') AS has_act FROM c", " FROM c")
ORACLE["stream_rel2abs"] = ORACLE["rel2abs_gripper"].replace(
    "SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t,", "SELECT traj_id, event_id,")
ORACLE["stream_interval_loss"] = ORACLE["interval_loss"]


# ----------------------------------------------------------------------------- projections / config
def long_of(expr_list: str, keys: str = "dataset_name, traj_id, t", src: str = "steps") -> str:
    return f"""SELECT {keys}, CAST(dim AS BIGINT) AS dim, {R('v')} AS value FROM (
  SELECT {keys}, unnest(range(0, len(arr))) AS dim, unnest(arr) AS v FROM (SELECT {keys}, {expr_list} AS arr FROM {src}))"""


KT = "dataset_name, traj_id, CAST(t AS BIGINT) AS t"
ORACLE["map_images"] = "WITH " + STEPS + f"\nSELECT {KT}, image AS image_primary, '' AS image_wrist, '' AS depth_primary FROM steps"
ORACLE["first_frame"] = "WITH " + STEPS + f"""
SELECT {KT}, first_value(image) OVER ({WO} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS image_first_frame,
       image AS image_first_frame_given FROM steps"""
ORACLE["concat_proprio"] = "WITH " + STEPS + "\n" + long_of(f"list_concat(state[1:3], [{Z}], world_vector)")
ORACLE["extract_language"] = "WITH " + STEPS + f"\nSELECT {KT}, language_instruction FROM steps"
ORACLE["default_fields"] = "WITH " + DIALOGUE + """
SELECT c.conv_id, '' AS user, coalesce(response, '') AS response, CAST(length(coalesce(conversation, '')) AS BIGINT) AS conv_len,
       'dialogue_ds' AS dataset_name
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN dlg ON dlg.conv_id = c.conv_id"""
ORACLE["absolute_mask"] = "WITH " + STEPS + f"""
SELECT {KT}, CAST(d.dim AS BIGINT) AS dim, d.dim = 6 AS absolute FROM steps, (SELECT unnest(range(0, 7)) AS dim) d"""
ORACLE["config_normalize"] = "WITH " + STEPS + LONG + STATS + f"""
SELECT l.dataset_name, l.traj_id, CAST(l.t AS BIGINT) AS t, CAST(l.dim AS BIGINT) AS dim, {R(norm_expr('bounds_q99', mask='l.dim < 6'))} AS value
FROM long l JOIN stats s USING (dataset_name, field, dim) WHERE l.field = 'action'"""
ORACLE["norm_mask"] = "WITH " + STEPS + """
SELECT DISTINCT dataset_name, 'action' AS field, CAST(d.dim AS BIGINT) AS dim, d.dim < 6 AS mask FROM steps, (SELECT unnest(range(0, 7)) AS dim) d"""
ORACLE["struct_merge"] = "WITH " + STEPS + f"""
SELECT {KT}, language_instruction, image, 'true' AS lang_mask, CAST(length(image) <> 0 AS VARCHAR) AS image_mask,
       CAST(t AS VARCHAR) AS timestep FROM steps"""
ORACLE["padding"] = "WITH " + STEPS + f"""
SELECT {KT}, CASE WHEN event_type = 'error' THEN '' ELSE image END AS image,
       CASE WHEN event_type = 'error' THEN '' ELSE language_instruction END AS language_instruction,
       {R("CASE WHEN event_type = 'error' THEN 0.0 ELSE gripper END")} AS gripper,
       {R("CASE WHEN event_type = 'error' THEN 0.0 ELSE list_sum(state) END")} AS state_sum FROM steps"""
ORACLE["example_projection"] = "WITH " + STEPS + f""",
e AS (SELECT s.*, b.image AS img0 FROM steps s JOIN steps b ON b.dataset_name = s.dataset_name AND b.traj_id = s.traj_id AND b.t = greatest(s.t - 1, 0))
SELECT dataset_name, img0 AS image, lower(language_instruction) AS lang,
       {R('list_sum(list_concat(world_vector, rotation_delta, [gripper]))')} AS action_sum, {R('list_sum(state)')} AS proprio_sum FROM e"""
ORACLE["speech_example_projection"] = "WITH " + DIALOGUE + """
SELECT 'conv ' || CAST(conv_id AS VARCHAR) AS lang, image, first_frame_image AS first_image, '' AS wrist_image, '' AS user, response,
       'dialogue_ds' AS dataset_name, CAST(length(conversation) AS BIGINT) AS conv_len, CAST(length(speech_conv) AS BIGINT) AS speech_len FROM dlg"""
ORACLE["episode_summary"] = "WITH " + STEPS + """
SELECT dataset_name, traj_id, count(*) AS size, arg_min(event_id, t) AS first_event_id, arg_max(event_id, t) AS last_event_id,
       arg_min(image, t) AS first_image, arg_max(image, t) AS last_image FROM steps GROUP BY ALL"""
ORACLE["episode_pieces"] = "WITH " + STEPS + """
SELECT dataset_name, traj_id, CAST(floor(t / 16) AS BIGINT) AS piece, count(*) AS n, arg_min(event_id, t) AS first_event,
       arg_max(event_id, t) AS last_event FROM steps GROUP BY ALL"""
ORACLE["pad_state"] = "WITH " + STEPS + "\n" + long_of(f"list_concat(state[1:6], [{Z}], [state[8]])")
ORACLE["rollout_state"] = "WITH " + STEPS + "\n" + long_of("list_concat(state[1:3], rotation_delta, [state[7], state[8]])")
ORACLE["slice_keys"] = "WITH " + STEPS + "\n" + long_of(f"[state[6], state[7], state[3], state[4], {Z}, {Z}, 1.0::DOUBLE]")

ORACLE["rotations"] = "WITH " + STEPS + f""",
e AS (SELECT dataset_name, traj_id, t, [state[5] / 60.0, state[6] / 60.0, state[3] / 100.0] AS e FROM steps),
r0 AS (SELECT *, {turn_x('e[1]')} AS fx, {turn_y('e[2]')} AS fy, {turn_z('e[3]')} AS fz FROM e),
r1 AS (SELECT *, {mm('fz', 'fy')} AS zy FROM r0),
r2 AS (SELECT *, {mm('zy', 'fx')} AS m FROM r1),
-- the angles are below a right angle, so they come back as they are; the inverse has rows and columns exchanged
r AS (SELECT dataset_name, traj_id, t, unnest([struct_pack(kind := 'm', arr := m), struct_pack(kind := 'back', arr := e),
        struct_pack(kind := 'inv', arr := [m[1], m[4], m[7], m[2], m[5], m[8], m[3], m[6], m[9]]), struct_pack(kind := 'r6', arr := m[1:6])]) AS p FROM r2),
r3 AS (SELECT dataset_name, traj_id, t, p.kind AS kind, unnest(range(0, len(p.arr))) AS dim, unnest(p.arr) AS v FROM r)
SELECT {KT}, kind, CAST(dim AS BIGINT) AS dim, {R('v')} AS value FROM r3"""
ORACLE["pose_matrix"] = "WITH " + STEPS + "\n" + long_of(
    "[0.0::DOUBLE, -sin(state[5] / 60.0), cos(state[5] / 60.0), state[1] / 100.0, 0, cos(state[5] / 60.0), sin(state[5] / 60.0), state[2] / 100.0, "
    "-1, 0, 0, state[3] / 100.0, 0, 0, 0, 1]")
ORACLE["decode_lower"] = "WITH " + STEPS + f"\nSELECT {KT}, lower(language_instruction) AS lang FROM steps"
ORACLE["parse_pair"] = "WITH " + STEPS + """
SELECT event_id, CAST(k AS BIGINT) AS w, CAST(hour(ts) AS BIGINT) AS h FROM steps"""
ORACLE["gather"] = "WITH " + STEPS + "\n" + long_of("[gripper, world_vector[1], rotation_delta[1]]")
ORACLE["zero_action_filter"] = "WITH " + STEPS + LONG + STATS + NORM_Q99 + """,
lens AS (SELECT dataset_name, traj_id, max(t) + 1 AS n FROM steps_a GROUP BY ALL),
z AS (SELECT dataset_name, dim, 2 * (0 - q01) / (q99 - q01 + 1e-8) - 1 AS z FROM stats WHERE field = 'action' AND dim < 6),
ch AS (SELECT a.dataset_name, a.traj_id, a.t, sl.slot, a.dim,
         CASE WHEN a.t + sl.slot > lens.n - 1 THEN 0.0 ELSE src.nx END AS v
       FROM norm a JOIN lens USING (dataset_name, traj_id), (SELECT unnest(range(0, 3)) AS slot) sl, norm src
       WHERE a.field = 'action' AND src.field = 'action' AND a.dim < 6 AND src.dataset_name = a.dataset_name
         AND src.traj_id = a.traj_id AND src.dim = a.dim AND src.t = least(a.t + sl.slot, lens.n - 1))
SELECT DISTINCT ch.dataset_name, ch.traj_id, CAST(ch.t AS BIGINT) AS t FROM ch JOIN z USING (dataset_name, dim) WHERE abs(ch.v - z.z) > 1e-5"""

STATS_OUT = f"""
SELECT dataset_name, field, CAST(dim AS BIGINT) AS dim, {R('mean')} AS mean, {R('std')} AS std, {R('max')} AS max, {R('min')} AS min,
       {R('q01')} AS q01, {R('q99')} AS q99 FROM stats"""
ORACLE["stats_roundtrip"] = "WITH " + STEPS + LONG + STATS + f""",
counts AS (SELECT dataset_name, count(*) AS num_transitions, count(DISTINCT traj_id) AS num_trajectories FROM steps_a GROUP BY dataset_name)
SELECT dataset_name, field, CAST(dim AS BIGINT) AS dim, {R('mean')} AS mean, {R('std')} AS std, {R('max')} AS max, {R('min')} AS min,
       {R('q01')} AS q01, {R('q99')} AS q99, CASE WHEN field = 'action' THEN dim < 6 END AS mask, num_transitions, num_trajectories
FROM stats JOIN counts USING (dataset_name)"""
ORACLE["cached_stats"] = ORACLE["dataset_stats"]
ORACLE["synthetic_steps"] = f"""
SELECT event_id, 'move the red block to the left' AS language_instruction, CAST(d.dim AS BIGINT) AS dim,
       {R(u01_sql(SEED, 'event_id', 'd.dim'))} AS value FROM events, (SELECT unnest(range(0, 7)) AS dim) d"""
ORACLE["dataset_stats_vectors"] = """WITH long AS (
  SELECT 'v' || CAST(label AS VARCHAR) AS dataset_name, 'action' AS field, CAST(d.dim AS INTEGER) AS dim, CAST(embedding[d.dim + 1] AS DOUBLE) AS x
  FROM embeddings, (SELECT unnest(range(0, 64)) AS dim) d)""" + STATS + STATS_OUT
ORACLE["dataset_stats_orders"] = """WITH long AS (
  SELECT 'lineitem' AS dataset_name, 'action' AS field, CAST(d.dim AS INTEGER) AS dim,
         [l_quantity, l_extendedprice, l_discount, l_tax][d.dim + 1] AS x
  FROM lineitem, (SELECT unnest(range(0, 4)) AS dim) d)""" + STATS + STATS_OUT


def _vec_norm(kind: str) -> str:
    return """WITH long AS (
  SELECT 'v' || CAST(label AS VARCHAR) AS dataset_name, vec_id AS traj_id, 'action' AS field, CAST(d.dim AS INTEGER) AS dim,
         CAST(embedding[d.dim + 1] AS DOUBLE) AS x
  FROM embeddings, (SELECT unnest(range(0, 64)) AS dim) d)""" + STATS + f"""
SELECT l.dataset_name, l.traj_id, CAST(l.dim AS BIGINT) AS dim, {R(norm_expr(kind))} AS value
FROM long l JOIN stats s USING (dataset_name, field, dim)"""


ORACLE["normalize_normal"] = _vec_norm("normal")
ORACLE["normalize_bounds"] = _vec_norm("bounds")

# ----------------------------------------------------------------------------- pipelines
ORACLE["episode_pipeline"] = "WITH " + STEPS + f""",
sa AS (SELECT *, list_concat(world_vector, rotation_delta, [gripper]) AS action FROM steps),
kept AS (SELECT dataset_name, traj_id FROM sa GROUP BY ALL
         HAVING bool_or(language_instruction <> '') AND bool_and(list_bool_and(list_transform(action, lambda x: abs(x) <= 450.0)))),
b AS (SELECT sa.*, count(*) OVER ({W}) AS n FROM sa SEMI JOIN kept USING (dataset_name, traj_id)),
g AS (SELECT b.*, least(CAST(floor({u01_sql(SEED, 'dataset_name', 'traj_id', 't')} * (n - (t + 1)) + (t + 1)) AS BIGINT), n - 1) AS goal_t FROM b),
gg AS (SELECT g.*, x.image AS goal_image0,
         ({u01_sql(SEED + 1, 'g.dataset_name', 'g.traj_id', 'g.t')} < 0.5 OR length(g.language_instruction) = 0) AS keep
       FROM g JOIN b x ON x.dataset_name = g.dataset_name AND x.traj_id = g.traj_id AND x.t = g.goal_t),
ta AS (SELECT dataset_name, traj_id, t, n, action,
         CASE WHEN keep THEN goal_t ELSE n - 1 END AS goal_t2,
         CASE WHEN keep THEN '' ELSE language_instruction END AS lang2,
         CASE WHEN keep THEN goal_image0 ELSE '' END AS goal_image2
       FROM gg),
sub AS (SELECT * FROM ta QUALIFY n <= 50 OR row_number() OVER ({W} ORDER BY {u01_sql(SEED + 2, 'dataset_name', 'traj_id', 't')}, t) <= 50),
tg AS (SELECT s.*, sl.slot, sl.slot - 1 AS off, d.dim FROM sub s, (SELECT unnest(range(0, 5)) AS slot) sl, (SELECT unnest(range(0, 7)) AS dim) d)
SELECT tg.dataset_name, tg.traj_id, CAST(tg.t AS BIGINT) AS t, CAST(tg.goal_t2 AS BIGINT) AS goal_t, tg.lang2 AS language_instruction,
       tg.goal_image2 AS goal_image, CAST(tg.slot AS BIGINT) AS slot, CAST(tg.dim AS BIGINT) AS dim,
       {R("CASE WHEN tg.t + tg.off > tg.n - 1 THEN (CASE WHEN tg.dim = 6 THEN y.action[tg.dim + 1] ELSE 0.0 END) ELSE y.action[tg.dim + 1] END")} AS value
FROM tg JOIN b y ON y.dataset_name = tg.dataset_name AND y.traj_id = tg.traj_id AND y.t = least(greatest(tg.t + tg.off, 0), tg.n - 1)"""

ORACLE["single_pipeline"] = chunk_rows("""SEMI JOIN (SELECT dataset_name, traj_id FROM steps_a GROUP BY ALL
  HAVING bool_or(language_instruction <> '')) l USING (dataset_name, traj_id)""")

ORACLE["interleaved_pipeline"] = "WITH " + STEPS + f""",
mix AS (SELECT dataset_name, count(*) AS size, CAST(substr(dataset_name, 3) AS INTEGER) AS pos,
               CASE CAST(substr(dataset_name, 3) AS INTEGER) WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
        FROM steps GROUP BY dataset_name),
mw AS (SELECT *, weight / sum(weight) OVER () AS sw FROM mix),
cdf AS (SELECT dataset_name, pos, sum(sw) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
               row_number() OVER (ORDER BY pos) - 1 AS idx FROM mw),
dlen AS (SELECT CAST(max(CASE WHEN weight = 1.0 THEN size / sw END) AS BIGINT) AS n FROM mw),
draws AS (SELECT r.draw, {u01_sql(SEED, 'r.draw')} AS u FROM (SELECT unnest(range(0, (SELECT n FROM dlen))) AS draw) r),
dd AS (SELECT draws.draw, least((SELECT count(*) FROM cdf WHERE cdf.hi <= draws.u), (SELECT count(*) FROM cdf) - 1) AS idx FROM draws),
dds AS (SELECT dd.draw, cdf.dataset_name FROM dd JOIN cdf USING (idx)),
dk AS (SELECT draw, dataset_name, row_number() OVER (PARTITION BY dataset_name ORDER BY draw) - 1 AS k FROM dds),
fr AS (SELECT dataset_name, traj_id, t, row_number() OVER (PARTITION BY dataset_name ORDER BY traj_id, t) - 1 AS fi,
              count(*) OVER (PARTITION BY dataset_name) AS size FROM steps),
j AS (SELECT dk.draw, dk.dataset_name, fr.traj_id, fr.t FROM dk JOIN fr ON fr.dataset_name = dk.dataset_name AND fr.fi = dk.k % fr.size),
p AS (SELECT *, row_number() OVER (ORDER BY {u01_sql(SEED + 3, 'draw')}, draw) - 1 AS pos FROM j)
SELECT pos, CAST(floor(pos / 32) AS BIGINT) AS batch, draw, dataset_name, traj_id, CAST(t AS BIGINT) AS t FROM p"""

ORACLE["std_droid_base"] = _std("""SELECT dataset_name, traj_id, t, list_concat(cv[1:3], cv[4:6], [1 - gpos[1]]) AS action,
  list_concat(cp, gpos) AS proprio FROM raw""", True)
ORACLE["std_nyu_franka"] = _std(f"""SELECT dataset_name, traj_id, t, list_concat(action[1:5], [{clip01('action[6]')}]) AS action,
  state[3:8] AS proprio FROM raw""", True)
ORACLE["std_iamlab"] = _std(f"""SELECT dataset_name, traj_id, t, list_concat(action_quat[1:3], {QUAT_EULER}, [action_quat[8]]) AS action FROM raw""", False)
ORACLE["std_bc_z"] = _std("""SELECT dataset_name, traj_id, t, list_concat(world_vector, rotation_delta, [1 - CAST(open_gripper AS DOUBLE)]) AS action FROM raw""", False)
ORACLE["std_autolab_ur5"] = _std(f"""SELECT dataset_name, traj_id, t, list_concat(world_vector, rotation_delta, [{W7}]) AS action,
  state[7:8] AS proprio FROM raw""", True)
ORACLE["rand_swap"] = "WITH " + STEPS + f"""
SELECT {KT}, CASE WHEN {u01_sql(SEED, 'dataset_name', 'traj_id')} > 0.5 THEN image || '#1' ELSE image || '#2' END AS exterior_image_1_left,
       CASE WHEN {u01_sql(SEED, 'dataset_name', 'traj_id')} > 0.5 THEN image || '#2' ELSE image || '#1' END AS exterior_image_2_left FROM steps"""
ORACLE["read_steps"] = "WITH " + STEPS + f"\nSELECT {KT}, event_id, image FROM steps"

# the next accepted step is the first one more than the gap after the last accepted one
ORACLE["rate_gate"] = """WITH RECURSIVE acc AS (
  SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL
  SELECT a.user_id, arg_min(e.event_id, (e.ts, e.event_id)) AS event_id, min(e.ts) AS ts
  FROM acc a JOIN events e ON e.user_id = a.user_id AND e.ts > a.ts + INTERVAL 4 HOUR GROUP BY a.user_id, a.ts)
SELECT user_id AS traj_id, event_id, event_id IN (SELECT event_id FROM acc) AS accepted FROM events"""

# ----------------------------------------------------------------------------- raw mixtures
RAW_MIXTURE = STEPS + """,
names AS (SELECT * FROM (VALUES (0, 'bridge_oxe'), (1, 'fractal20220817_data'), (2, 'libero_spatial_no_noops'), (3, 'taco_play'),
                                (4, 'tdroid_carrot_in_bowl')) v(k5, name)),
r AS (SELECT s.* EXCLUDE (dataset_name), n.name AS dataset_name, n.k5, max(s.t) OVER (PARTITION BY s.traj_id) AS tmax,
             -- relative gripper: last step beyond the threshold, before the first one its opposite, else open
             last_value(CASE WHEN rel_gripper < -0.1 THEN 1 WHEN rel_gripper > 0.1 THEN -1 END IGNORE NULLS) OVER (
               PARTITION BY s.traj_id ORDER BY s.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g_before,
             first_value(CASE WHEN rel_gripper < -0.1 THEN 1 WHEN rel_gripper > 0.1 THEN -1 END IGNORE NULLS) OVER (
               PARTITION BY s.traj_id ORDER BY s.t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS g_first,
             -- absolute gripper: the next decided value, else the episode's last raw one
             first_value(CASE WHEN gripper > 0.95 THEN 1.0 WHEN gripper < 0.05 THEN 0.0 END IGNORE NULLS) OVER (
               PARTITION BY s.traj_id ORDER BY s.t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g_next,
             last_value(gripper) OVER (PARTITION BY s.traj_id ORDER BY s.t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS g_last,
             lead(state) OVER (PARTITION BY s.traj_id ORDER BY s.t) AS next_state
      FROM steps s JOIN names n ON n.k5 = s.traj_id % 5),
std AS MATERIALIZED (
  SELECT dataset_name, traj_id, CASE WHEN k5 = 0 THEN t - 1 ELSE t END AS t, event_id, language_instruction,
         CASE k5 WHEN 0 THEN list_concat(list_transform(range(1, 7), lambda i: next_state[i] - state[i]), [CASE WHEN gripper > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END])
                 WHEN 1 THEN list_concat(world_vector, rotation_delta, [coalesce(g_before, -g_first, 1) / 2.0::DOUBLE + 0.5])
                 WHEN 2 THEN list_concat(world_vector, rotation_delta, [1.0::DOUBLE - greatest(least(gripper * 2 - 0.5, 1.0), 0.0)])
                 WHEN 3 THEN list_concat(world_vector, rotation_delta, [greatest(least(rel_gripper * 1.5, 1.0), 0.0)::DOUBLE])
                 ELSE list_concat(world_vector, rotation_delta, [coalesce(g_next, g_last)::DOUBLE]) END AS action,
         CASE k5 WHEN 0 THEN list_concat(state[1:6], [state[8]]) WHEN 2 THEN list_concat(state[1:6], state[7:8])
                 WHEN 3 THEN list_concat(state[1:6], [state[8]]) WHEN 4 THEN list_concat(state[1:6], [gripper]) END AS proprio
  FROM r WHERE k5 <> 0 OR (t > 0 AND t < tmax))"""

ORACLE["std_mixture"] = "WITH " + RAW_MIXTURE + f"""
SELECT dataset_name, traj_id, CAST(t AS BIGINT) AS t, event_id, language_instruction, field, CAST(dim AS BIGINT) AS dim, {R('x')} AS value FROM (
  SELECT dataset_name, traj_id, t, event_id, language_instruction, 'action' AS field, unnest(range(0, 7)) AS dim, unnest(action) AS x FROM std
  UNION ALL SELECT dataset_name, traj_id, t, event_id, language_instruction, 'proprio', unnest(range(0, len(proprio))), unnest(proprio) FROM std WHERE proprio IS NOT NULL)"""

ORACLE["single_pipeline_raw"] = "WITH " + RAW_MIXTURE + f""",
long AS MATERIALIZED (SELECT dataset_name, traj_id, t, 'action' AS field, unnest(range(0, 7)) AS dim, unnest(action) AS x FROM std)""" + STATS + NORM_Q99 + f""",
ch AS (SELECT dataset_name, traj_id, t, dim, [nx, {", ".join(f"lead(nx, {k}, 0.0) OVER w" for k in range(1, 6))}] AS c FROM norm
       WINDOW w AS (PARTITION BY dataset_name, traj_id, dim ORDER BY t)),
ex AS (SELECT dataset_name, traj_id, t, dim, unnest(range(0, 6)) AS slot, unnest(c) AS v FROM ch)
SELECT dataset_name, traj_id, CAST(slot AS BIGINT) AS slot, CAST(dim AS BIGINT) AS dim, count(*) AS n,
       {R('sum(round(v, 6))')} AS total, {R('sum(round(v, 6) * (t + 1))')} AS weighted
FROM ex GROUP BY dataset_name, traj_id, slot, dim"""

ORACLE["interleaved_pipeline_raw"] = "WITH " + RAW_MIXTURE + f""",
mix AS (SELECT k5 AS pos, name AS dataset_name, 1.0::DOUBLE + k5 % 3 AS weight FROM names WHERE name IN (SELECT dataset_name FROM std)),
mw AS (SELECT *, weight / sum(weight) OVER () AS sw FROM mix),
cdf AS (SELECT dataset_name, pos, sum(sw) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
               row_number() OVER (ORDER BY pos) - 1 AS idx FROM mw),
draws AS (SELECT r.draw, {u01_sql(SEED, 'r.draw')} AS u FROM (SELECT unnest(range(0, 4000)) AS draw) r),
dd AS (SELECT draws.draw, least((SELECT count(*) FROM cdf WHERE cdf.hi <= draws.u), (SELECT count(*) FROM cdf) - 1) AS idx FROM draws),
dk AS (SELECT draw, dataset_name, row_number() OVER (PARTITION BY dataset_name ORDER BY draw) - 1 AS k FROM dd JOIN cdf USING (idx)),
fr AS (SELECT dataset_name, traj_id, t, language_instruction, row_number() OVER (PARTITION BY dataset_name ORDER BY traj_id, t) - 1 AS fi,
              count(*) OVER (PARTITION BY dataset_name) AS size FROM std),
j AS (SELECT dk.draw, dk.dataset_name, fr.traj_id, fr.t, fr.language_instruction FROM dk JOIN fr ON fr.dataset_name = dk.dataset_name AND fr.fi = dk.k % fr.size),
p AS (SELECT *, row_number() OVER (ORDER BY {u01_sql(SEED + 3, 'draw')}, draw) - 1 AS pos FROM j)
SELECT pos, CAST(floor(pos / 32) AS BIGINT) AS batch, draw, dataset_name, traj_id, CAST(t AS BIGINT) AS t, length(language_instruction) < 7 AS short FROM p"""

ORACLE["redrawn_goals"] = "WITH " + STEPS + f""",
mix AS (SELECT dataset_name, count(*) AS size, CAST(substr(dataset_name, 3) AS INTEGER) AS pos FROM steps GROUP BY dataset_name),
cdf AS (SELECT dataset_name, pos, sum(1.0::DOUBLE / (SELECT count(*) FROM mix)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
               row_number() OVER (ORDER BY pos) - 1 AS idx FROM mix),
draws AS (SELECT r.draw, {u01_sql(SEED, 'r.draw')} AS u FROM (SELECT unnest(range(0, 2 * (SELECT count(*) FROM events))) AS draw) r),
dd AS (SELECT draws.draw, least((SELECT count(*) FROM cdf WHERE cdf.hi <= draws.u), (SELECT count(*) FROM cdf) - 1) AS idx FROM draws),
dk AS (SELECT draw, dataset_name, row_number() OVER (PARTITION BY dataset_name ORDER BY draw) - 1 AS k FROM dd JOIN cdf USING (idx)),
fr AS (SELECT dataset_name, traj_id, t, row_number() OVER (PARTITION BY dataset_name ORDER BY traj_id, t) - 1 AS fi, count(*) OVER (PARTITION BY dataset_name) AS size,
              count(*) OVER (PARTITION BY dataset_name, traj_id) AS n FROM steps),
j AS (SELECT dk.draw, dk.k // fr.size AS pass, fr.* FROM dk JOIN fr ON fr.dataset_name = dk.dataset_name AND fr.fi = dk.k % fr.size),
g AS (SELECT *, CAST(least(floor({u01_sql(SEED + 5, 'dataset_name', 'traj_id', 't', 'pass')} * (n - (t + 1)) + (t + 1)), n - 1) AS BIGINT) AS goal_t FROM j)
SELECT g.draw, g.pass, g.dataset_name, g.traj_id, CAST(g.t AS BIGINT) AS t, g.goal_t, s.image AS goal_image
FROM g JOIN steps s ON s.dataset_name = g.dataset_name AND s.traj_id = g.traj_id AND s.t = g.goal_t"""
