"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"""
words AS (
  SELECT doc_id, list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
)"""

OP5 = (
    "WITH "
    + _WORDS.format(text="coalesce(text, '')")
    + """,
wins AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM words WHERE len(w) >= 13
), keyed AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + 12], ' ')) AS k FROM wins
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM (
    SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM keyed
  ) WHERE doc_id > least
), cut AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(
    list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256
FROM words LEFT JOIN cut USING (doc_id)
"""
)

OP2 = (
    "WITH RECURSIVE "
    + _WORDS.format(text=r"translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p : p + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), coded AS MATERIALIZED (
  SELECT doc_id, hash(s) AS s FROM shingles
), links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM coded a JOIN coded b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n
  HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM words
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM words w LEFT JOIN sizes USING (doc_id) JOIN least ON x = w.doc_id
"""
)

OP7 = r"""
WITH docs AS (
  SELECT doc_id, source, md5('mix-0:' || doc_id::VARCHAR) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source
), swept AS (
  SELECT *, (sum(source_size) OVER () - 3 * (sum(source_size) OVER w - source_size))
    / (sum(weight) OVER () - (sum(weight) OVER w - weight)) AS level
  FROM sources WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), final AS (
  SELECT max(level) AS level FROM swept WHERE level * weight <= 3 * source_size
), targets AS (
  SELECT source, source_size, least(final.level * weight, 3.0 * source_size)::DOUBLE AS target
  FROM swept, final
), placed AS (
  SELECT doc_id, size, source_size, target,
    sum(size) OVER (PARTITION BY docs.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  (size * (rounds + CASE WHEN target - rounds * source_size > 0
    AND before + size / 2 <= target - rounds * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

OP3 = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages
), led AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS lead FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN lead = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN lead <> page_id THEN lead END AS refers_to
FROM led
"""

OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND NOT list_bool_or(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)))
    AND NOT list_bool_and(list_transform(e, lambda x: x = 0))
), links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
), counts AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON least.x = v.vec_id LEFT JOIN counts ON counts.x = v.vec_id
"""

# crc32 of a list of byte values, with its table as a one-row query.
_CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
)"""


def _crc(text: str) -> str:
    """Of a text whose code points lie below U+0800."""
    values = f"""flatten(list_transform(string_split({text}, ''), lambda c:
      CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
      ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END))"""
    return f"""xor(list_reduce([4294967295::BIGINT] || {values},
      lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"""


OP11 = f"""WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table
), counts AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
      ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), spots AS MATERIALIZED (
  SELECT word, n, left(word, i - 1) AS head, substr(word, i + 1) AS tail
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM counts)
), shorter AS MATERIALIZED (
  SELECT a.word AS long, a.n AS long_n, b.word AS short, b.n AS short_n
  FROM (SELECT DISTINCT word, n, head || tail AS rest FROM spots) a JOIN counts b ON b.word = a.rest
), pairs AS (
  SELECT a.word, b.word AS near, b.n FROM spots a JOIN spots b
  ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT long, short, short_n FROM shorter
  UNION ALL SELECT short, long, long_n FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n
  FROM pairs GROUP BY word
), formed AS MATERIALIZED (
  SELECT word, c.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN near_n >= 10 * c.n THEN near END AS form, CASE WHEN near_n >= 10 * c.n THEN near_n END AS form_n
  FROM counts c LEFT JOIN best USING (word)
), chain AS (
  SELECT word, form AS root, 1 AS step FROM formed WHERE form IS NOT NULL
  UNION ALL
  SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)
"""


def _further(state: str, cost: str, edit: str, turn: str | None) -> str:
    """A state's cheapest cost, audit and text after one more edit."""
    get = lambda field: f"struct_extract({state}, '{field}')"
    text = get("text") + (f" || chr(10) || {turn}" if turn else "")
    return (
        f"CASE WHEN {state} IS NULL THEN NULL ELSE "
        f"{{'cost': {get('cost')} + {cost}, 'audit': {get('audit')} || '{edit}', 'text': {text}}} END"
    )


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _repair_step() -> str:
    """One row after another over four states: nothing yet, system, user, assistant."""
    s = [f"a.st[{i}]" for i in range(1, 5)]
    user = lambda x: _further(x, "2", "I", "'user:'")
    assistant = lambda x: _further(x, "2", "I", "'assistant:'")
    w = [s[0], s[1], _least(s[2], user(s[0]), user(s[1]), user(s[3]))]
    w.append(_least(s[3], assistant(s[2]), assistant(user(s[0])), assistant(user(s[1]))))

    def edit(state: str, when: str, cost: str, letter: str, turn: str) -> str:
        return f"CASE WHEN b.kind < 2 AND {when} THEN {_further(state, cost, letter, turn)} END"

    def keep(state: str, initial: int) -> str:
        return edit(state, f"b.initial = {initial}", "(b.kind = 1)::BIGINT", "K", "b.role || ':' || b.text")

    def rerole(state: str, role: str) -> str:
        return edit(state, "true", "2 + (b.kind = 1)::BIGINT", "R", f"'{role}:' || b.text")

    gone = [_further(x, "3", "D", None) for x in w]
    before_user = [w[0], w[1], w[3]]
    states = [
        gone[0],
        _least(gone[1], keep(w[0], 0)),
        _least(gone[2], *[keep(x, 1) for x in before_user], *[rerole(x, "user") for x in before_user]),
        _least(gone[3], keep(w[2], 2), rerole(w[2], "assistant")),
    ]
    return f"{{'st': [{', '.join(states)}], 'kind': b.kind, 'initial': b.initial, 'role': b.role, 'text': b.text}}"


def _repair_end() -> str:
    s = [f"done.st[{i}]" for i in range(1, 5)]
    closing = _further(_further(s[1], "2", "I", "'user:'"), "2", "I", "'assistant:'")
    return _least(s[0], s[3], _further(s[2], "2", "I", "'assistant:'"), closing)


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STATE = "STRUCT(cost BIGINT, audit VARCHAR, text VARCHAR)[]"
OP13 = f"""WITH {_CRC_TABLE}, hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE h <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
    sha256(length(role) || ':' || role || ':' || text), copy) AS i FROM damaged
), judged AS (
  SELECT *, right(rtrim(text, {_WHITE}), 1) AS tail,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), faults AS (
  SELECT *, CASE WHEN tail = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' END AS fault,
    before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au') AS is_illegal
  FROM judged
), listed AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (is_illegal) AS illegal,
    list({{'st': NULL::{_STATE}, 'kind': CASE WHEN fault IN ('b', 'd') THEN 2 WHEN fault = 't' THEN 1 ELSE 0 END,
      'initial': CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END,
      'role': role, 'text': text}} ORDER BY i) AS turns
  FROM faults GROUP BY conv_id
), solved AS (
  SELECT * EXCLUDE turns, list_reduce([{{'st': [{{'cost': 0::BIGINT, 'audit': '', 'text': ''}}, NULL, NULL, NULL]::{_STATE},
    'kind': 0, 'initial': 0, 'role': '', 'text': ''}}] || turns,
    lambda a, b: {_repair_step()}) AS done
  FROM listed
), ended AS (
  SELECT * EXCLUDE done, {_repair_end()} AS found FROM solved
), every AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(found.cost, 0)::BIGINT AS cost,
  coalesce(found.audit, '') AS audit, sha256(substr(coalesce(found.text, ''), 2)) AS repaired_sha256
FROM every e LEFT JOIN ended d ON e.conv_id IS NOT DISTINCT FROM d.conv_id
"""

ORACLES = {
    "op9_embedding_near_dedup": OP9,
    "op3_warc": OP3,
    "op7_source_mix": OP7,
    "op2_ngram_jaccard_join": OP2,
    "op5_substring_dedup": OP5,
    "op11_spelling_variants": OP11,
    "op13_conversation_repair": OP13,
}
