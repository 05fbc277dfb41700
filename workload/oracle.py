"""SQL counterparts of the registered queries, written for DuckDB.

They restate the rules on their own terms (texts are rebuilt and recounted at every cut, joins
and windows are global), so that agreement says something about the Spark plans.
"""

from __future__ import annotations

from continuum.config import CURRENT, OLD, StudyConfig
from continuum.functions.text import WHITESPACE, WHITESPACE_CLASS
from continuum.operators.prompts import SYSTEM_TEXT, USER_TEMPLATE
from continuum.sources.catalogue import COMPARISON_GROUPS, EXPECTED_CLASSES, MODELS, RUNS
from workload.fixtures import N_FAULTS, UNKNOWN_RUN
from workload.queries import N_SHARDS


def _q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def _values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(_q(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


_WS = _q(WHITESPACE)
_PAD = "lpad(CAST(doc_id AS VARCHAR), CAST(greatest(5, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0')"


def _words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[^{WHITESPACE_CLASS}]+')) AS INTEGER)"


def _strip(x: str) -> str:
    return f"trim({x}, {_WS})"


_SENTENCES = (
    "list_filter(list_transform(string_split(regexp_replace(clean, "
    f"'([.!?][\"”’)]*[{WHITESPACE_CLASS}]+)([A-Z“\"(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), "
    f"lambda x: trim(x, {_WS})), lambda x: x <> '')"
)

_STORIES = f"""stories AS (
  SELECT doc_id, {_PAD} AS story_id, text,
         {_strip("regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')")} AS clean,
         {_words('text')} AS n_words
  FROM documents)"""

_SPLIT = f"""split AS (
  SELECT *, CAST(len(sentences) AS INTEGER) AS n FROM (SELECT *, {_SENTENCES} AS sentences FROM stories))"""


def _cuts(config: StudyConfig) -> str:
    pcts = ", ".join(f"({p})" for p in config.position_pcts)
    return f"""pcts(pct) AS (VALUES {pcts}),
cuts AS (
  SELECT DISTINCT story_id, doc_id, n, n_words, sentences,
         CAST(greatest(1, least(round_even(CAST(pct AS DOUBLE) * n, 0), n - 1)) AS INTEGER) AS position
  FROM split, pcts WHERE n >= {config.min_sentences} AND n_words <= {config.max_words}),
pos0 AS (
  SELECT *, array_to_string(sentences[1:position], ' ') AS prefix,
         array_to_string(sentences[position + 1:n], ' ') AS truth
  FROM cuts),
pos AS (SELECT *, {_words('prefix')} AS prefix_words, {_words('truth')} AS target_n_words FROM pos0)"""


_BEFORE_COUNT, _REST = USER_TEMPLATE.split("{n_words}")
_BEFORE_STORY, _AFTER_STORY = _REST.split("{story_so_far}")
_USER_TEXT = (
    f"{_q(_BEFORE_COUNT)} || CAST(target_n_words AS VARCHAR) || {_q(_BEFORE_STORY)} || prefix || {_q(_AFTER_STORY)}"
)

_RUNS = ",\n".join(
    [
        _values(
            "run_rows",
            "run_no, run, model, tp, thinking, mult",
            [(r.run_no, r.run, r.model, r.tensor_parallel_size, r.thinking, r.max_tokens_mult) for r in RUNS],
        ),
        _values("model_rows", "model, is_base, is_reasoning, is_vlm, is_mistral", MODELS),
        """runs AS (
  SELECT r.run_no, r.run, r.model, r.tp, CAST(r.mult AS DOUBLE) AS mult,
         CASE WHEN m.is_base THEN 'base_raw' ELSE 'chat' END AS prompt_mode, m.is_reasoning,
         (m.is_reasoning AND r.thinking) AS enable_thinking, (m.is_reasoning AND r.thinking) AS strip_think
  FROM run_rows r JOIN model_rows m USING (model))""",
    ]
)


def _budget(words: str, mult: str, strip: str) -> str:
    c = CURRENT
    b = f"(CASE WHEN {strip} THEN {c.thinking_tokens} ELSE 0 END)"
    clamp = f"(CASE WHEN {strip} THEN {c.thinking_clamp} ELSE {c.token_clamp} END)"
    scaled = f"floor(CAST({words} AS DOUBLE) * CAST({c.tokens_per_word} AS DOUBLE) * CAST({mult} AS DOUBLE))"
    return f"CAST(least(greatest({scaled} + {b}, {c.token_floor} + {b}), {clamp}) AS INTEGER)"


_REQUESTS = f"""prompted AS (
  SELECT story_id, doc_id, n, n_words, position, prefix, truth, target_n_words, prefix_words,
         {_USER_TEXT} AS user_text FROM pos),
counted AS (
  SELECT *, {_words('user_text')} + {_words(_q(SYSTEM_TEXT))} AS chat_words FROM prompted),
all_requests AS (
  SELECT r.*, c.* EXCLUDE (chat_words), {_budget('target_n_words', 'mult', 'strip_think')} AS max_tokens,
         CAST(ceil(CAST(CASE WHEN prompt_mode = 'base_raw' THEN prefix_words ELSE chat_words END AS DOUBLE)
              * CAST({CURRENT.tokens_per_word} AS DOUBLE)) AS INTEGER) AS prompt_tokens_est
  FROM counted c CROSS JOIN runs r)"""


def _guarded(limit: int) -> str:
    return f"requests AS (SELECT * FROM all_requests WHERE prompt_tokens_est + max_tokens <= {limit})"


def _strip_reasoning(x: str) -> str:
    paired = f"regexp_replace({x}, '(?is)<think>.*?</think>', '', 'g')"
    return _strip(f"regexp_replace({paired}, '(?is)\\A.*?</think>', '')")


_SHAPES = """CASE {k} % 4 WHEN 0 THEN text WHEN 1 THEN concat('<think>plan A. B</think>', text)
              WHEN 2 THEN concat('plan A. B</think> ', text) ELSE concat('<think>cut off ', text) END"""

def _answers(n: int) -> str:
    return f"""turns AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS k, text FROM conversations WHERE role = 'assistant'),
samples AS (
  SELECT run, story_id, position, CAST(s AS INTEGER) AS sample_idx,
         (run_no * 7 + doc_id * 20 + position * 5 + s) % (SELECT count(*) FROM turns) AS k,
         (run_no * 31 + doc_id * 17 + position * 7 + s) % {N_FAULTS} AS fault
  FROM requests, range({n}) AS g(s)),
drawn AS (
  SELECT run, story_id, position, sample_idx, fault, {_SHAPES.format(k='k')} AS raw_text
  FROM samples JOIN turns USING (k)),
raw AS (
  SELECT run, story_id, position, sample_idx, CASE WHEN fault IN (1, 5) THEN 1 ELSE 0 END AS delivery,
         CASE WHEN fault = 4 THEN '' ELSE raw_text END AS raw_text
  FROM drawn WHERE fault <> 3
  UNION ALL
  SELECT CASE WHEN fault = 8 THEN '{UNKNOWN_RUN}' ELSE run END,
         CASE WHEN fault = 10 THEN story_id || 'x' ELSE story_id END,
         CASE WHEN fault = 9 THEN position + 1000 ELSE position END,
         CASE WHEN fault = 7 THEN 99 ELSE sample_idx END,
         CASE WHEN fault = 2 THEN 1 ELSE 0 END,
         CASE WHEN fault IN (1, 2) THEN '' WHEN fault = 5 THEN 'first try ' || raw_text
              WHEN fault = 6 THEN 'zz ' || raw_text ELSE raw_text END
  FROM drawn WHERE fault IN (1, 2, 5, 6, 7, 8, 9, 10)),
cleaned AS (
  SELECT run, story_id, position, sample_idx, delivery,
         CASE WHEN strip_think THEN {_strip_reasoning('raw_text')} ELSE {_strip('raw_text')} END AS continuation
  FROM raw JOIN runs USING (run)),
folded AS (
  SELECT run, story_id, position, sample_idx, continuation FROM cleaned WHERE sample_idx BETWEEN 0 AND {n - 1}
  QUALIFY row_number() OVER (PARTITION BY run, story_id, position, sample_idx
                             ORDER BY continuation = '', delivery DESC, encode(continuation)) = 1),
gathered AS (
  SELECT run, story_id, position, count(*) AS n_out,
         string_agg(continuation, chr(10) ORDER BY sample_idx) AS continuations
  FROM folded GROUP BY ALL),
answers AS (SELECT f.* FROM folded f SEMI JOIN requests USING (run, story_id, position)),
attached AS (SELECT g.* FROM gathered g SEMI JOIN requests USING (run, story_id, position)),
delivered AS (
  SELECT run, story_id, position, count(*) AS got, min(sample_idx) AS low, max(sample_idx) AS high,
         bool_or(texts > 1) AS differs
  FROM (SELECT run, story_id, position, sample_idx, count(DISTINCT raw_text) AS texts FROM raw r
        WHERE delivery = (SELECT max(delivery) FROM raw l WHERE l.run = r.run AND l.story_id = r.story_id
                          AND l.position = r.position AND l.sample_idx = r.sample_idx) GROUP BY ALL)
  GROUP BY run, story_id, position)"""


_ANSWERS = _answers(CURRENT.n_continuations)


def _records(config: StudyConfig) -> str:
    pcts = ",".join(str(p) for p in config.position_pcts)
    return f"""record_positions AS (
  SELECT q.run, q.story_id, count(*) AS n_positions_emitted, coalesce(sum(n_out), 0) AS n_continuations,
         bool_and(coalesce(n_out, 0) = {config.n_continuations}) AS complete,
         string_agg(concat_ws(chr(10), q.position, q.position, n - q.position,
             round_even(q.position / CAST(n AS DOUBLE) * 100, 1), target_n_words, prefix, truth,
             coalesce(continuations, '')), chr(10) ORDER BY q.position) AS whole
  FROM requests q LEFT JOIN attached USING (run, story_id, position) GROUP BY ALL),
records AS (
  SELECT run, story_id, n AS n_sentences, n_words, CAST(count(*) AS INTEGER) AS n_positions_evaluated,
         CAST(coalesce(any_value(p.n_positions_emitted), 0) AS INTEGER) AS n_positions_emitted,
         CAST(coalesce(any_value(p.n_continuations), 0) AS INTEGER) AS n_continuations,
         {config.n_continuations} AS n_continuations_per_position, CAST({config.temperature} AS DOUBLE) AS temperature,
         CAST({config.top_p} AS DOUBLE) AS top_p, model, prompt_mode, enable_thinking AS thinking_enabled,
         tp AS tensor_parallel_size, mult AS max_tokens_mult, 'documents.parquet' AS source_file,
         'none' AS quantization, '{pcts}' AS position_pcts,
         md5(coalesce(any_value(p.whole), '')) AS positions_md5
  FROM all_requests LEFT JOIN record_positions p USING (run, story_id)
  GROUP BY run, story_id, n, n_words, model, prompt_mode, enable_thinking, tp, mult
  HAVING coalesce(any_value(p.complete), true))"""


_RECORDS = _records(CURRENT)

_DONE = f"""done AS (
  SELECT run, {_PAD} AS story_id FROM labels, runs
  WHERE prompt_mode = 'base_raw' OR (NOT strip_think AND quality = 1))"""


def _with(*parts_and_query: str) -> str:
    *parts, query = parts_and_query
    return "WITH " + ",\n".join(parts) + "\n" + query


_BASE = (_STORIES, _SPLIT)
_POS = (*_BASE, _cuts(CURRENT))
_REQ = (*_POS, _RUNS, _REQUESTS, _guarded(CURRENT.context_length))
_ANS = (*_REQ, _ANSWERS)
_REQ_4096 = (*_POS, _RUNS, _REQUESTS, _guarded(4096))
_COUNTED = """SELECT * REPLACE (CAST(CASE WHEN run_no % 2 = 0 AND doc_id % 3 = 0 THEN prompt_tokens_est * 2
    ELSE prompt_tokens_est END AS INTEGER) AS prompt_tokens_est) FROM all_requests"""
_REQ_COUNTED = (
    *_POS, _RUNS, _REQUESTS,
    f"requests AS (SELECT * FROM ({_COUNTED}) WHERE prompt_tokens_est + max_tokens <= 4096)",
)

_POSITIONS_SQL = """SELECT story_id, position, position AS n_context_sentences,
  n - position AS n_remaining_sentences,
  round_even(position / CAST(n AS DOUBLE) * 100, 1) AS pct_story_revealed, target_n_words FROM pos"""

_REQUEST_SQL = "SELECT run, story_id, position, max_tokens, prompt_tokens_est FROM "

_RECORD_SQL = "SELECT * FROM records"


def _compare(kind: str, sides: tuple[str, ...]) -> str:
    names = {r.run_no: r.run for r in RUNS}
    members = [(m.group_id, m.ord, names[m.run_no]) for m in COMPARISON_GROUPS if m.kind == kind]
    texts = ", ".join(
        f"md5(any_value(continuations) FILTER (WHERE ord = {i})) AS {s}_md5" for i, s in enumerate(sides, start=1)
    )
    return _with(
        *_ANS,
        _values("members", "group_id, ord, run", members),
        f"""SELECT group_id, story_id, position, {texts}
  FROM members JOIN gathered USING (run) GROUP BY group_id, story_id, position
  HAVING count(DISTINCT ord) = {len(sides)}""",
    )


_EXPECTED = _values("expected", "model, expected_type", EXPECTED_CLASSES)
_CHECK_MODEL_CLASS = """SELECT 'model_class' AS "check", q.model AS subject, count(*) AS n,
  CASE WHEN bool_and(coalesce(CASE e.expected_type
      WHEN 'base' THEN m.is_base AND NOT m.is_reasoning AND q.prompt_mode = 'base_raw'
      WHEN 'instruct' THEN NOT m.is_base AND NOT m.is_reasoning AND q.prompt_mode = 'chat'
      WHEN 'reasoning' THEN m.is_reasoning AND NOT m.is_base AND q.prompt_mode = 'chat' END, false))
    THEN 'pass' ELSE 'fail' END AS status
  FROM all_requests q LEFT JOIN model_rows m USING (model) LEFT JOIN expected e USING (model) GROUP BY q.model"""


def _fault(check: str, n: str, source: str) -> str:
    return f"""SELECT '{check}' AS "check", run AS subject, CAST({n} AS BIGINT) AS n,
  CASE WHEN {n} = 0 THEN 'pass' ELSE 'fail' END AS status FROM {source} GROUP BY run"""


_THINK_LEAK = _fault(
    "think_leak", "count(*) FILTER (WHERE regexp_matches(continuation, '(?i)</?think>'))", "cleaned"
)
_RIGHT = f"got = {CURRENT.n_continuations} AND low = 0 AND high = {CURRENT.n_continuations - 1} AND NOT differs"
_OUTPUT_COUNT = f"""SELECT * FROM ({_fault(
    "output_count",
    f"count(*) FILTER (WHERE NOT coalesce({_RIGHT}, false))",
    "requests LEFT JOIN delivered USING (run, story_id, position)",
)}) UNION ALL {_fault(
    "orphan_output",
    "count(*) FILTER (WHERE max_tokens IS NULL)",
    "requests FULL JOIN delivered USING (run, story_id, position)",
)}"""
_EMPTY_OUTPUT = _fault("empty_output", "count(*) FILTER (WHERE continuation = '')", "cleaned")
_WRITTEN = "\nUNION ALL ".join(
    f"""SELECT '{check}' AS "check", run AS subject, CAST(coalesce({n}, 0) AS BIGINT) AS n,
  CASE WHEN coalesce({n}, 0) {good} THEN 'pass' ELSE 'fail' END AS status
  FROM runs LEFT JOIN (SELECT run, story_id, continuation, 0 AS wrong FROM records JOIN answers USING (run, story_id))
  USING (run) GROUP BY run"""
    for check, n, good in [
        ("think_leak", "count(*) FILTER (WHERE regexp_matches(continuation, '(?i)</?think>'))", "= 0"),
        ("empty_output", "count(*) FILTER (WHERE continuation = '')", "= 0"),
        ("output_count", "sum(wrong)", "= 0"),
        ("missing_runs", "count(DISTINCT story_id)", "> 0"),
    ]
)
_PROMPTS = _fault(
    "prompts",
    f"""count(*) FILTER (WHERE CASE WHEN prompt_mode = 'base_raw' THEN {_strip('prefix')} = ''
      ELSE user_text = '' OR (regexp_matches(user_text, '(?i)</?think>') AND NOT enable_thinking) END)""",
    "requests",
)
_MISSING_RUNS = """SELECT 'missing_runs' AS "check", r.run AS subject, count(d.story_id) AS n,
  CASE WHEN count(d.story_id) > 0 THEN 'pass' ELSE 'fail' END AS status
  FROM runs r LEFT JOIN done d USING (run) GROUP BY r.run"""

_ALL_CHECKS = "\nUNION ALL ".join(
    f"({c})" for c in [_CHECK_MODEL_CLASS, _THINK_LEAK, _OUTPUT_COUNT, _EMPTY_OUTPUT, _PROMPTS, _MISSING_RUNS]
)


def _funnel(id_filter: bool) -> str:
    c = CURRENT
    listed = (
        f"TRY_CAST(story_id AS BIGINT) >= {c.min_story_id} AND TRY_CAST(story_id AS BIGINT) < {c.max_story_id}"
        if id_filter
        else "true"
    )
    stages = {
        "scanned": "true",
        "in_id_range": "listed",
        "discovered": "found",
        "long_enough": f"found AND n >= {c.min_sentences}",
        "too_short": f"found AND n < {c.min_sentences}",
    }
    body = "\nUNION ALL ".join(
        f"SELECT '{name}' AS stage, count(*) AS n, min(story_id) AS first_id, max(story_id) AS last_id "
        f"FROM flagged WHERE {cond}"
        for name, cond in stages.items()
    )
    if id_filter:
        body += f"""
UNION ALL SELECT 'shard_' || CAST(shard AS VARCHAR), count(*), min(story_id), max(story_id)
FROM (SELECT story_id, ntile({N_SHARDS}) OVER (ORDER BY story_id) - 1 AS shard FROM flagged WHERE found) GROUP BY shard"""
    return _with(
        *_BASE,
        f"flagged AS (SELECT story_id, n, {listed} AS listed, {listed} AND n_words <= {c.max_words} AS found FROM split)",
        body,
    )


ORACLE_SQL: dict[str, str] = {
    "corpus_scan": _with(_STORIES, "SELECT story_id, CAST(length(clean) AS INTEGER) AS n_chars_clean FROM stories"),
    "normalize_text": _with(
        _STORIES,
        "SELECT story_id, CAST(length(clean) AS INTEGER) AS n_chars_clean, md5(clean) AS text_md5 FROM stories",
    ),
    "word_count": _with(_STORIES, "SELECT story_id, n_words FROM stories"),
    "word_cap": _with(_STORIES, f"SELECT story_id, n_words FROM stories WHERE n_words <= {CURRENT.max_words}"),
    "word_cap_300": _with(_STORIES, "SELECT story_id, n_words FROM stories WHERE n_words <= 300"),
    "sentences": _with(
        *_BASE,
        """SELECT story_id, CAST(i - 1 AS INTEGER) AS idx, sentences[i] AS sentence
  FROM (SELECT story_id, sentences, unnest(range(1, n + 1)) AS i FROM split)""",
    ),
    "story_stats": _with(*_BASE, "SELECT story_id, n AS n_sentences, n_words FROM split"),
    "min_sentences": _with(
        *_BASE,
        f"SELECT story_id, n AS n_sentences, n_words FROM split WHERE n >= {CURRENT.min_sentences}",
    ),
    "strip_reasoning": f"""SELECT conv_id, turn, CAST(s AS INTEGER) AS shape, {_strip_reasoning('raw_text')} AS clean_text
  FROM (SELECT conv_id, turn, s, {_SHAPES.format(k='s')} AS raw_text FROM conversations, range(4) AS g(s))""",
    "id_range": _with(
        _STORIES,
        f"""SELECT story_id FROM stories WHERE TRY_CAST(story_id AS BIGINT) >= {CURRENT.min_story_id}
  AND TRY_CAST(story_id AS BIGINT) < {CURRENT.max_story_id}""",
    ),
    "id_list": _with(
        _STORIES, "SELECT story_id FROM stories WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"
    ),
    "shard": _with(
        _STORIES,
        f"""SELECT story_id, CAST(ntile({N_SHARDS}) OVER (ORDER BY story_id) - 1 AS INTEGER) AS shard_id
  FROM stories""",
    ),
    "shard_index": _with(
        _STORIES,
        f"""SELECT CAST(shard AS INTEGER) AS shard_id, count(*) AS n_stories, min(story_id) AS first_id, max(story_id) AS last_id
  FROM (SELECT story_id, ntile({N_SHARDS}) OVER (ORDER BY story_id) - 1 AS shard FROM stories
        WHERE n_words <= {CURRENT.max_words}) GROUP BY shard""",
    ),
    "shard_stories": _with(
        _STORIES,
        f"""SELECT story_id, n_words FROM (SELECT *, ntile({N_SHARDS}) OVER (ORDER BY story_id) - 1 AS shard FROM stories
        WHERE n_words <= {CURRENT.max_words}) WHERE shard = 2""",
    ),
    "first_n": _with(_STORIES, "SELECT story_id FROM stories ORDER BY story_id LIMIT 25"),
    "resume": _with(
        _STORIES,
        "SELECT story_id FROM stories s WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.doc_id)",
    ),
    "positions": _with(*_POS, _POSITIONS_SQL),
    "positions_old": _with(*_BASE, _cuts(OLD), _POSITIONS_SQL),
    "stream_positions": _with(*_POS, _POSITIONS_SQL),
    "prefix_truth": _with(
        *_POS, "SELECT story_id, position, prefix, truth AS ground_truth_continuation FROM pos"
    ),
    "token_budget": _with(
        *_POS,
        "modes(thinking, mult) AS (VALUES (false, 1.3), (true, 2.0))",
        f"""SELECT story_id, position, thinking, {_budget('target_n_words', 'mult', 'thinking')} AS max_tokens
  FROM pos, modes""",
    ),
    "prompt_base": _with(*_POS, "SELECT story_id, position, prefix AS prompt FROM pos"),
    "prompt_chat": _with(
        *_POS,
        f"SELECT story_id, position, {_q(SYSTEM_TEXT)} AS system_text, {_USER_TEXT} AS user_text FROM pos",
    ),
    "requests_old": _with(*_BASE, _cuts(OLD), _RUNS, _REQUESTS, _REQUEST_SQL + "all_requests"),
    "requests": _with(*_POS, _RUNS, _REQUESTS, _REQUEST_SQL + "all_requests"),
    "pending_requests": _with(
        *_REQ,
        _DONE,
        _REQUEST_SQL
        + "requests q WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.run = q.run AND d.story_id = q.story_id)",
    ),
    "context_guard": _with(*_REQ, _REQUEST_SQL + "requests"),
    "context_guard_4096": _with(*_REQ_4096, _REQUEST_SQL + "requests"),
    "run_catalogue": _with(
        *_REQ,
        """SELECT run, model, prompt_mode, enable_thinking, strip_think, mult, count(*) AS n_requests,
  CAST(sum(max_tokens) AS BIGINT) AS sum_max_tokens FROM requests GROUP BY ALL""",
    ),
    "model_class": _with(
        *_POS,
        _RUNS,
        _REQUESTS,
        """SELECT model, CASE WHEN m.is_base THEN 'base' WHEN m.is_reasoning THEN 'reasoning' ELSE 'instruct' END
    AS model_class, m.is_base, m.is_reasoning, m.is_vlm, m.is_mistral, count(*) AS n_requests
  FROM all_requests q JOIN model_rows m USING (model) GROUP BY ALL""",
    ),
    "export_prompts": _with(
        *_REQ,
        """SELECT run, story_id, position, CASE WHEN prompt_mode = 'base_raw' THEN md5(prefix) END AS prompt_md5,
  CASE WHEN prompt_mode <> 'base_raw' THEN md5(user_text) END AS user_md5,
  CASE WHEN is_reasoning THEN CAST(enable_thinking AS VARCHAR) END AS enable_thinking, max_tokens FROM requests""",
    ),
    "attach_completions": _with(
        *_ANS, "SELECT run, story_id, position, sample_idx, md5(continuation) AS continuation_md5 FROM answers"
    ),
    "finetune_rows": _with(
        *_ANS,
        """SELECT run, story_id, position, sample_idx, md5(prefix) AS prefix_md5, md5(truth) AS ground_truth_md5,
  md5(continuation) AS continuation_md5 FROM folded JOIN pos USING (story_id, position)""",
    ),
    "pending_records": _with(
        *_ANS,
        _RECORDS,
        _DONE,
        _RECORD_SQL + " ANTI JOIN done USING (run, story_id)",
    ),
    "nest_story": _with(*_ANS, _RECORDS, _RECORD_SQL),
    "nest_story_old": _with(
        *_BASE,
        _cuts(OLD),
        _RUNS.replace("JOIN model_rows m USING (model))", "JOIN model_rows m USING (model) WHERE run_no IN (1, 2, 9, 10))"),
        _REQUESTS,
        _guarded(OLD.context_length),
        _answers(OLD.n_continuations),
        _records(OLD),
        _RECORD_SQL,
    ),
    "nest_story_4096": _with(*_REQ_4096, _ANSWERS, _RECORDS, _RECORD_SQL),
    "requests_counted": _with(*_REQ_COUNTED, _REQUEST_SQL + "requests"),
    "export_counted": _with(
        *_REQ_COUNTED,
        "SELECT run, story_id, position, CASE WHEN prompt_mode = 'base_raw' THEN md5(prefix) END AS prompt_md5, max_tokens FROM requests",
    ),
    "nest_story_counted": _with(*_REQ_COUNTED, _ANSWERS, _RECORDS, _RECORD_SQL),
    "written_checks": _with(*_ANS, _RECORDS, _WRITTEN),
    "story_result_json": _with(*_ANS, _RECORDS, _RECORD_SQL),
    "compare_pairs": _compare("pair", ("left", "right")),
    "compare_stages": _compare("stages", ("base", "sft", "dpo", "final")),
    "funnel_counts": _funnel(True),
    "funnel_index": _funnel(True),
    "funnel_counts_all": _funnel(False),
    "progress_counts": _with(
        *_BASE,
        _RUNS,
        _DONE,
        f"""SELECT r.run, count(*) FILTER (WHERE d.run IS NULL AND n >= {CURRENT.min_sentences}) AS n_processed,
  count(*) FILTER (WHERE d.run IS NOT NULL) AS n_skipped,
  count(*) FILTER (WHERE d.run IS NULL AND n < {CURRENT.min_sentences}) AS n_too_short
  FROM (SELECT * FROM split WHERE n_words <= {CURRENT.max_words}) s CROSS JOIN runs r
  LEFT JOIN done d ON d.run = r.run AND d.story_id = s.story_id GROUP BY r.run""",
    ),
    "progress_by_run": _with(_RUNS, _DONE, "SELECT run, count(*) AS n FROM done GROUP BY run"),
    "check_model_class": _with(*_POS, _RUNS, _REQUESTS, _EXPECTED, _CHECK_MODEL_CLASS),
    "check_think_leak": _with(*_ANS, _THINK_LEAK),
    "check_output_count": _with(*_ANS, _OUTPUT_COUNT),
    "check_empty_output": _with(*_ANS, _EMPTY_OUTPUT),
    "check_prompts": _with(*_REQ, _PROMPTS),
    "check_missing_runs": _with(_RUNS, _DONE, _MISSING_RUNS),
    "check_summary": _with(
        *_ANS,
        _EXPECTED,
        _DONE,
        f"""SELECT "check", status, count(*) AS n FROM ({_ALL_CHECKS}) GROUP BY "check", status""",
    ),
}
