"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from continuum.llm import balltree as B
from continuum.llm import decontaminate as D
from continuum.llm import mixing as M
from continuum.llm import quality as Q
from continuum.llm import variants as V


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _count(of: str, characters: str) -> str:
    return f"(length({of}) - length(translate({of}, {_text(characters)}, '')))"


def _words(of: str) -> str:
    return rf"len(regexp_extract_all({of}, '[^\x20\x09-\x0D]+'))"


_PHRASES = " OR ".join(f"contains(lower(line), {_text(p)})" for p in Q.BOILERPLATE)
_BARS = _count("line", Q.SEPARATORS)

QUALITY = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
         generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS p
  FROM base
), windows AS (
  SELECT r, p, string_agg(word, ' ') OVER w AS win, count(*) OVER w AS n
  FROM worded WINDOW w AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {Q.WINDOW - 1} FOLLOWING)
), twins AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, win) AS c FROM windows WHERE n = {Q.WINDOW}
), steps AS (
  SELECT r, least({Q.WINDOW}, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, {Q.WINDOW})) AS s
  FROM twins WHERE c > 1
), repeats AS (
  SELECT r, sum(s) AS n_repeat FROM steps GROUP BY r
), lines AS (
  SELECT r, line,
    {_BARS} * 5 > length(line)
      OR ({_BARS} > 0 AND {_BARS} * 3 > {_words("line")})
      OR {_count("line", Q.NOISE)} * 10 > length(line)
      OR {_count("line", "!")} * 20 > length(line)
      OR (length(line) <= {Q.BOILERPLATE_CHARS} AND ({_PHRASES}))
      OR (NOT contains({_text(Q.SENTENCE_ENDS)}, right(trim(line, {_SPACES}), 1))
          AND {_words("line")} < {Q.MIN_OPEN_WORDS}) AS fails
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE trim(line, {_SPACES}) <> ''
), per_doc AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup, sum(length(line)) AS chars,
         coalesce(sum(length(line)) FILTER (NOT fails), 0) AS kept_chars
  FROM lines GROUP BY r
), measured AS (
  SELECT doc_id, {_words("text")} AS n_words,
         length(translate(text, {_SPACES}, '')) AS word_chars,
         {_count("text", Q.SYMBOLS)} AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
         coalesce(chars, 0) AS chars, coalesce(kept_chars, 0) AS kept_chars
  FROM base LEFT JOIN per_doc USING (r) LEFT JOIN repeats USING (r)
), failed AS (
  SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM measured
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND kept_chars >= chars * {Q.MIN_KEPT_SHARE} AS kept
FROM failed
"""

ORACLE_SQL = {"op7_line_cleaning": QUALITY}

MIXING = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce('=' || source, '') AS src,
         {_words("coalesce(text, '')")} + 1 AS n_tokens,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))), 1, 8)
              AS BIGINT) AS key
  FROM documents
), totals AS (
  SELECT src, sum(n_tokens) AS tokens FROM docs GROUP BY src
), ends AS (
  SELECT CAST(max(tokens) AS DOUBLE) AS large, CAST(min(tokens) AS DOUBLE) AS small FROM totals
), halving AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT k + 1,
         CASE WHEN pow(large / small, 1 - (low + high) / 2) <= {M.REPETITIONS} THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(large / small, 1 - (low + high) / 2) <= {M.REPETITIONS} THEN (low + high) / 2 ELSE high END
  FROM halving, ends WHERE k < {M.STEPS}
), chosen AS (
  SELECT round(high, {M.DECIMALS}) AS x FROM halving WHERE k = {M.STEPS}
), plan AS (
  SELECT src, tokens, pow(CAST(tokens AS DOUBLE), x) / sum(pow(CAST(tokens AS DOUBLE), x)) OVER () AS weight,
         floor(pow(large / tokens, 1 - x)) AS passes,
         CAST(floor((pow(large / tokens, 1 - x) - floor(pow(large / tokens, 1 - x))) * tokens) AS BIGINT) AS quota,
         greatest(1, CAST(ceil(tokens / {M.BLOCK}.0) AS BIGINT)) AS n_blocks
  FROM totals, ends, chosen
), placed AS (
  SELECT docs.*, weight, CAST(passes AS INTEGER) AS passes, quota, key % n_blocks AS block
  FROM docs JOIN plan USING (src)
), ordered AS (
  SELECT *, sum(n_tokens) OVER (
    PARTITION BY src
    ORDER BY CAST('0x' || substr(md5(src || ':' || block || ':' || passes), 1, 8) AS BIGINT), block, key, doc_id
    ROWS UNBOUNDED PRECEDING) AS used
  FROM placed
)
SELECT doc_id, source, e AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens, round(weight, 9) AS weight
FROM (
  SELECT *, CAST(unnest(range(passes)) AS INTEGER) AS e FROM placed
  UNION ALL BY NAME
  SELECT * EXCLUDE (used), passes AS e FROM ordered WHERE used <= quota
)
"""

ORACLE_SQL["op5_temperature_mix"] = MIXING


def _folded(of: str) -> str:
    return f"translate({of}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_TERMS = rf"regexp_extract_all({_folded("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op11_benchmark_hits"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents
), tests AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, words, least({D.WINDOW}, len(words)) AS size
  FROM (SELECT item_id, {_TERMS} AS words FROM benchmark)
), windows AS (
  SELECT item, size, array_to_string(words[p : p + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS p FROM tests WHERE size > 0)
), places AS (
  SELECT r, p, size, array_to_string(words[p : p + size - 1], ' ') AS win
  FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS p
        FROM docs, (SELECT DISTINCT size FROM windows))
), found AS (
  SELECT DISTINCT r, p, places.size, item FROM places JOIN windows USING (size, win)
), hit AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

ORACLE_SQL["op12_lexical_search"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents
), sized AS (
  SELECT r, doc_id, words, CAST(len(words) AS BIGINT) AS n FROM docs WHERE len(words) > 0
), overall AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized
), counted AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM sized) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), overall
), wanted AS (
  SELECT i, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY i, item_id, term
), scored AS (
  SELECT i, item_id, r, doc_id,
         CAST(sum(times * w * ((1000000000 * tf)
           // (1000 * tf + 8 * (100 - {B.LENGTH_PERCENT} + ({B.LENGTH_PERCENT} * n * docs) // terms)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN counted USING (term) JOIN sized USING (r), overall
  GROUP BY i, item_id, r, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {B.TOP}
"""

ORACLE_SQL["op13_spelling_variants"] = rf"""
WITH RECURSIVE runs AS (
  SELECT id, run, count(*) AS c
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
               unnest(regexp_extract_all({_folded("coalesce(text, '')")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
        FROM documents)
  GROUP BY id, run
), numbered AS (
  SELECT *, row_number() OVER () AS k, hex(encode(id || ':' || run)) AS bytes FROM runs
), crc_table AS (
  SELECT x, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, x) AS t
  FROM (SELECT unnest(range(256)) AS x)
), registers AS (
  SELECT k, bytes, 4294967295 AS c FROM numbered
  UNION ALL
  SELECT k, substr(bytes, 3), xor(t, c >> 8)
  FROM registers JOIN crc_table ON x = xor(c, CAST('0x' || substr(bytes, 1, 2) AS BIGINT)) & 255
  WHERE bytes <> ''
), hashed AS (
  SELECT numbered.*, xor(registers.c, 4294967295) AS h FROM numbered JOIN registers USING (k) WHERE registers.bytes = ''
), spelled AS (
  SELECT c, CASE WHEN h % {V.TYPO_EVERY} = 0
                 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelled
  WHERE length(word) >= {V.MIN_LENGTH} GROUP BY word HAVING sum(c) >= {V.MIN_COUNT}
), shorter AS (
  SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest
  FROM (SELECT *, unnest(range(length(word))) AS p FROM words)
), near AS (
  SELECT a.word AS a, a.n AS n_a, b.word AS b, b.n AS n_b
  FROM shorter AS a JOIN shorter AS b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM shorter AS a JOIN words AS b ON a.rest = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM shorter AS a JOIN words AS b ON a.rest = b.word
), counted AS (
  SELECT a, count(*) AS n_near FROM near GROUP BY a
), forms AS (
  SELECT a, b AS form, n_b AS form_n FROM near WHERE n_b >= {V.RATIO} * n_a
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY n_b DESC, encode(b)) = 1
), walks AS (
  SELECT a, form AS goal FROM forms
  UNION ALL
  SELECT walks.a, forms.form FROM walks JOIN forms ON walks.goal = forms.a
), ends AS (
  SELECT a, goal FROM walks WHERE goal NOT IN (SELECT a FROM forms)
)
SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form, form_n, coalesce(goal, word) AS root
FROM words LEFT JOIN counted ON word = counted.a LEFT JOIN forms ON word = forms.a LEFT JOIN ends ON word = ends.a
"""
