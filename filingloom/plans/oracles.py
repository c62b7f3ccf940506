"""SQL that says the same as the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from filingloom.operators.tokens import IRREGULAR_NOUNS, NOUN_ENDINGS
from filingloom.plans.registry import CLUSTER_LABELS, K, TOPIC_LABELS

# Spark's general English stop words of four and more letters
# without an apostrophe (shorter ones fall to the length test, and apostrophes
# are deleted before the test).
ENGLISH = """
myself ours ourselves your yours yourself yourselves himself hers herself itself they them their
theirs themselves what which whom this that these those were been being have having does doing
because until while with about against between into through during before after above below from
down over under again further then once here there when where both each more most other some such
only same than very will just should ought could cannot would
""".split()
CONTRACTIONS = ["cannot", "gimme", "gonna", "gotta", "lemme", "wanna"]

SP = r"\s\pZ\x0b\x1c-\x1f\x{85}"


def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in sorted(set(words)))


def _values(pairs) -> str:
    return ", ".join(f"({k}, '{v}')" for k, v in pairs)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, ' +', ' ', 'g')")


def clean(x: str) -> str:
    x = f"regexp_replace({x}, '<[^<]+?>', '', 'g')"
    x = f"regexp_replace({x}, '&#\\d+;', '', 'g')"
    x = squeeze(f"regexp_replace({x}, '(?i)&nbsp;', ' ', 'g')")
    return f"regexp_replace({x}, '\\n[{SP}]*\\n', chr(10) || chr(10), 'g')"


def wc(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '[{SP}]+'), lambda w: w <> ''))"


RAW = f"""string_split_regex(
    regexp_replace(lower(text), '[^a-z{SP}]+', '', 'g'), '[{SP}]+')"""
RAW_WORDS = f"list_filter({RAW}, lambda w: w <> '' AND w NOT IN ({_quoted(CONTRACTIONS)}))"
STOP = _quoted([*ENGLISH, *CONTRACTIONS])
KEPT = f"list_filter({RAW}, lambda w: length(w) >= 4 AND w NOT IN ({STOP}))"

CORPUS = "corpus AS (SELECT doc_id, source AS ticker, 2023 + (doc_id // 20) % 2 AS year, text FROM documents)"
TOKS = f"toks AS (SELECT doc_id, {KEPT} AS tokens FROM documents)"
WORDS = "words AS (SELECT doc_id, unnest(tokens) AS token FROM toks)"
BAG = "bag AS (SELECT doc_id, token, count(*) AS cnt FROM words GROUP BY ALL)"
FREQ = "freq AS (SELECT token, count(*) AS df, sum(cnt)::BIGINT AS tf FROM bag GROUP BY token)"
VOC = """voc AS (
    SELECT token, df, tf, row_number() OVER (ORDER BY df DESC, token) - 1 AS id FROM freq
    WHERE df >= 3 AND df <= floor(0.7 * (SELECT count(*) FROM toks)))"""
VOCABULARY = ", ".join([TOKS, WORDS, BAG, FREQ, VOC])
LANG_TOPICS = f"""{", ".join([TOKS, WORDS, BAG, FREQ])}, lang_n AS (
    SELECT CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END::BIGINT AS topic,
           token AS term, sum(cnt) AS n
    FROM bag JOIN documents USING (doc_id) GROUP BY ALL),
phi AS (SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS weight FROM lang_n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM phi)"""

THETA = f"""theta_raw AS (
    SELECT vec_id AS doc_id, 'T' || (vec_id % 10) AS ticker, 2023 + (vec_id // 10) % 2 AS year,
           list_transform(range({K}), lambda t: list_sum(list_transform(range(t + 1, len(embedding) + 1, {K}), lambda i: abs(embedding[i]::DOUBLE)))) AS w FROM embeddings),
theta AS (
    SELECT doc_id, ticker, year, unnest(range({K})) AS topic,
           unnest(w) / list_sum(w) AS weight FROM theta_raw)"""
EXPOSURE = f"""{THETA}, exposure AS (
    SELECT ticker, topic, avg(weight) AS exposure FROM theta GROUP BY ALL)"""
LABELS = f"labels_t(topic, label) AS (VALUES {_values(TOPIC_LABELS.items())})"
NAME = "'Topic_' || topic || ': ' || coalesce(label, 'Generic Risk ' || topic)"
CLUSTER_T = f"labels_c(cluster, label) AS (VALUES {_values(CLUSTER_LABELS.items())})"

NET = f"""net AS (
    SELECT 'C' || lpad((vec_id % 40)::VARCHAR, 2, '0') AS ticker, t AS topic,
           avg(list_sum(list_transform(range(t + 1, len(embedding) + 1, {K}),
                                       lambda i: greatest(embedding[i]::DOUBLE, 0)))) AS w
    FROM embeddings, range({K}) r(t) GROUP BY ALL),
sizes AS (SELECT ticker, sqrt(sum(w * w)) AS n FROM net GROUP BY ticker),
sims AS (
    SELECT a.ticker AS src, b.ticker AS dst, sum(a.w * b.w) / (x.n * y.n) AS weight
    FROM net a JOIN net b ON a.topic = b.topic AND a.ticker < b.ticker
    JOIN sizes x ON x.ticker = a.ticker JOIN sizes y ON y.ticker = b.ticker
    WHERE x.n > 0 AND y.n > 0
    GROUP BY a.ticker, b.ticker, x.n, y.n)"""
COMPONENTS = f"""{NET}, links AS (
    SELECT src AS a, dst AS b FROM sims WHERE weight > 0.97
    UNION SELECT dst, src FROM sims WHERE weight > 0.97),
reach(ticker, other) AS (
    SELECT DISTINCT ticker, ticker FROM net
    UNION SELECT reach.ticker, links.b FROM reach JOIN links ON links.a = reach.other),
comp AS (SELECT ticker, min(other) AS component FROM reach GROUP BY ticker)"""


def _drift(how: str = "first", base: str = "exp(1)") -> str:
    pick = "arg_min(weight, doc_id)" if how == "first" else "avg(weight)"
    return f"""{THETA}, yearly AS (
    SELECT ticker, topic, {pick} FILTER (year = 2023) AS p, {pick} FILTER (year = 2024) AS q
    FROM theta GROUP BY ALL HAVING count(DISTINCT year) = 2),
floored AS (SELECT *, greatest(p, 1e-10) AS fp, greatest(q, 1e-10) AS fq FROM yearly),
scaled AS (
    SELECT ticker, topic, fp / sum(fp) OVER w AS fp, fq / sum(fq) OVER w AS fq
    FROM floored WINDOW w AS (PARTITION BY ticker)),
drift AS (
    SELECT ticker, sqrt(greatest(sum(fp * ln(2 * fp / (fp + fq)) + fq * ln(2 * fq / (fp + fq))), 0)
                        / 2 / ln({base})) AS jsd
    FROM scaled GROUP BY ticker)"""


POINTS = "pts AS (SELECT vec_id AS para_id, label AS cluster, embedding::DOUBLE[] AS v FROM embeddings)"
CENTRES = f"""{POINTS}, dims AS (
    SELECT para_id, cluster, unnest(v) AS x, unnest(range(len(v))) AS d FROM pts),
centres AS (SELECT cluster, d, avg(x) AS c FROM dims GROUP BY ALL),
near AS (
    SELECT cluster, para_id, sqrt(sum((x - c) * (x - c))) AS distance
    FROM dims JOIN centres USING (cluster, d) GROUP BY ALL)"""


def _silhouette(distance: str, points: str = POINTS) -> str:
    return f"""{points}, gaps AS (
    SELECT a.para_id, a.cluster, b.cluster AS other, sum({distance}) AS s, count(*) AS n
    FROM pts a, pts b GROUP BY ALL),
ab AS (
    SELECT para_id, cluster,
           max(CASE WHEN cluster = other THEN s / greatest(n - 1, 1) END) AS a,
           max(CASE WHEN cluster = other THEN n END) AS own,
           min(CASE WHEN cluster <> other THEN s / n END) AS b
    FROM gaps GROUP BY ALL),
sil AS (
    SELECT para_id, cluster, CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END AS silhouette
    FROM ab)"""


COUNTS = f"""{LANG_TOPICS}, top AS (SELECT topic, term, rank FROM ranked WHERE rank <= 20),
listed AS (SELECT DISTINCT term FROM top),
spots AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM toks),
hits AS (SELECT spots.* FROM spots JOIN listed USING (term)),
total AS (
    SELECT sum(greatest(1, n - 109)) AS windows FROM (SELECT DISTINCT doc_id, n FROM hits)),
windowed AS (
    SELECT DISTINCT doc_id, term,
           unnest(range(greatest(0, pos - 109), least(pos, greatest(0, n - 110)) + 1)) AS win
    FROM hits),
marked AS (SELECT topic, doc_id, win, rank FROM windowed JOIN top USING (term)),
pairs AS (
    SELECT topic, a.rank AS i, b.rank AS j, count(*) AS n
    FROM marked a JOIN marked b USING (topic, doc_id, win) GROUP BY ALL),
probs AS (
    SELECT a.topic, a.rank AS i, b.rank AS j, coalesce(p.n, 0) / windows AS pij,
           pi.n / windows AS pi, pj.n / windows AS pj
    FROM top a JOIN top b USING (topic) CROSS JOIN total
    LEFT JOIN pairs p ON p.topic = a.topic AND p.i = a.rank AND p.j = b.rank
    LEFT JOIN pairs pi ON pi.topic = a.topic AND pi.i = a.rank AND pi.j = a.rank
    LEFT JOIN pairs pj ON pj.topic = a.topic AND pj.i = b.rank AND pj.j = b.rank),
npmi AS (
    SELECT topic, i, j,
           coalesce(ln((pij + 1e-12) / (pi * pj)) / -ln(pij + 1e-12), 0) AS v FROM probs)"""

FILINGS = f"""raw AS (
    SELECT 'file:/filings/' || source || CASE WHEN doc_id % 7 = 0 THEN '/10-Q/a' ELSE '/10-K/a' END
           || doc_id || '/full-submission.txt' AS path,
           CASE WHEN doc_id % 11 = 0 THEN 'NO PERIOD' || chr(10)
                ELSE 'CONFORMED PERIOD OF REPORT:' || chr(9) || (2023 + (doc_id // 20) % 2) || '1231' || chr(10) END
           || CASE WHEN doc_id % 13 = 0 THEN 'Item 7. Other ' ELSE 'Item 1A. Risk Factors ' END
           || text || chr(10) || 'Item 1B. Unresolved' AS value
    FROM documents)"""
PAGE_FILINGS = """raw AS (
    SELECT 'file:/filings/site' || (page_id % 50) || '/10-K/a' || page_id || '/full-submission.txt' AS path,
           'CONFORMED PERIOD OF REPORT:' || chr(9) || (2023 + (page_id // 20) % 2) || '1231' || chr(10)
           || 'ITEM 1A RISK  FACTORS&nbsp;&#160;' || chr(10) || ' ' || chr(10)
           || html || chr(10) || 'Item 2. Properties' AS value
    FROM pages)"""
START = f"Item[{SP}]+1A\\.?[{SP}]+Risk[{SP}]+Factors"
SECTION = f"(?is){START}(.*?)(?:Item[{SP}]+(?:1B|2)\\.?|\\z)"


def _extract(raw: str, text: str) -> str:
    return f"""WITH {raw}, body AS (
    SELECT path, regexp_replace(value, '\\r\\n?', chr(10), 'g') AS value FROM raw),
cut AS (
    SELECT regexp_extract(path, '/([^/]+)/10-K/', 1) AS ticker,
           try_cast(regexp_extract(value, 'CONFORMED PERIOD OF REPORT:[{SP}]+(\\d{{4}})', 1) AS BIGINT) AS year,
           {clean(strip(text))} AS text
    FROM body WHERE regexp_matches(value, '(?i){START}'))
SELECT ticker, year, text, {wc("text")} AS word_count FROM cut
WHERE ticker <> '' AND year IS NOT NULL"""


ORACLES = {
    "corpus_stats": f"""WITH {CORPUS}
SELECT count(*) AS documents, count(DISTINCT ticker) AS companies, count(DISTINCT year) AS years,
       sum({wc("text")})::BIGINT AS words FROM corpus""",
    "docs_per_year": f"WITH {CORPUS} SELECT year, count(*) AS documents FROM corpus GROUP BY year",
    "corpus_preview": f"""WITH {CORPUS}
SELECT doc_id, ticker, year, text, {wc("text")} AS word_count FROM corpus ORDER BY doc_id LIMIT 5""",
    "period_filter": f"""WITH {CORPUS}
SELECT doc_id, ticker, year FROM corpus WHERE year = 2024 AND ticker IN ('src1', 'src3', 'src12')""",
    "filing_extract": _extract(FILINGS, f"regexp_extract(value, '{SECTION}', 1)"),
    "filing_extract_html": _extract(PAGE_FILINGS, f"regexp_extract(value, '{SECTION}', 1)"),
    "filing_longest": _extract(
        FILINGS.replace("CASE WHEN doc_id % 11", "'Item 1A. Risk Factors 12' || chr(10) || 'Item 2. 30' || chr(10) || CASE WHEN doc_id % 11"),
        f"""(SELECT arg_max(s, length(s) * 1000 - i) FROM (
            SELECT unnest(regexp_extract_all(value, '{SECTION}', 1)) AS s,
                   generate_subscripts(regexp_extract_all(value, '{SECTION}', 1), 1) AS i))""",
    ),
    "flat_filings": f"""SELECT source AS ticker, 2023 + (doc_id // 20) % 2 AS year,
       regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text,
       {wc("text")} AS word_count FROM documents WHERE doc_id % 9 <> 0""",
    "html_clean": f"SELECT page_id, {clean('html')} AS text FROM pages",
    "word_count": f"SELECT doc_id, {wc('text')} AS word_count FROM documents",
    "tokens": f"""WITH {TOKS}
SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM toks""",
    "stopword_filter": f"""WITH toks AS (
    SELECT doc_id, list_filter({RAW_WORDS}, lambda w: length(w) >= 4) AS tokens FROM documents),
{WORDS}, {BAG}, frequent AS (
    SELECT token FROM bag GROUP BY token HAVING count(*) > 0.1 * (SELECT count(*) FROM toks)),
spots AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM toks),
kept AS (
    SELECT doc_id, count(*) AS n_tokens, string_agg(token, ' ' ORDER BY pos) AS tokens
    FROM spots WHERE token NOT IN (SELECT token FROM frequent) GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(kept.tokens, '') AS tokens
FROM (SELECT doc_id FROM toks) LEFT JOIN kept USING (doc_id)""",
    "mean_tokens": f"""WITH {TOKS}
SELECT count(*) AS documents, round(avg(len(tokens)), 6) AS mean_tokens FROM toks""",
    "token_preview": f"""WITH {TOKS}
SELECT doc_id, array_to_string(tokens[1:20], ' ') AS tokens FROM toks""",
    "vocabulary": f"WITH {VOCABULARY} SELECT token, df, tf, id FROM voc",
    "vocabulary_capped": f"WITH {VOCABULARY} SELECT token, df, tf, id FROM voc WHERE id < 500",
    "vocabulary_size": f"""WITH {VOCABULARY}
SELECT count(*) AS terms, (SELECT count(*) FROM freq) - count(*) AS dropped,
       (SELECT count(*) FROM toks) AS documents FROM voc""",
    "bag_of_words": f"""WITH {VOCABULARY}
SELECT doc_id, token, id, cnt FROM bag JOIN voc USING (token)""",
    "document_lengths": f"""WITH {VOCABULARY}
SELECT doc_id, sum(cnt)::BIGINT AS length FROM bag JOIN voc USING (token) GROUP BY doc_id""",
    "topic_keywords": f"""WITH {LANG_TOPICS}
SELECT topic, string_agg(printf('%.3f', weight) || '*"' || term || '"', ' + ' ORDER BY rank) AS keywords
FROM ranked WHERE rank <= 10 GROUP BY topic""",
    "topic_terms_ranked": f"""WITH {LANG_TOPICS}
SELECT topic, rank, term, round(weight, 9) AS weight FROM ranked WHERE rank <= 30""",
    "term_relevance": f"""WITH {LANG_TOPICS}, shares AS (
    SELECT token AS term, tf / sum(tf) OVER () AS p FROM freq),
scored AS (
    SELECT topic, term, round(0.6 * ln(weight) + 0.4 * ln(weight / p), 9) AS relevance
    FROM phi JOIN shares USING (term)),
best AS (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, term) AS rank FROM scored)
SELECT topic, rank, term, round(relevance, 6) AS relevance FROM best WHERE rank <= 30""",
    "topic_distance": f"""WITH {LANG_TOPICS}, grid AS (
    SELECT t.topic, term, coalesce(weight, 0) AS w
    FROM (SELECT DISTINCT topic FROM phi) t CROSS JOIN (SELECT DISTINCT term FROM phi) d
    LEFT JOIN phi USING (topic, term)),
duo AS (
    SELECT a.topic AS topic_a, b.topic AS topic_b, a.w AS x, b.w AS y
    FROM grid a JOIN grid b ON a.term = b.term AND a.topic < b.topic)
SELECT topic_a, topic_b, round(sqrt(greatest(sum(
    CASE WHEN x > 0 THEN x * ln(2 * x / (x + y)) ELSE 0 END
    + CASE WHEN y > 0 THEN y * ln(2 * y / (x + y)) ELSE 0 END) / 2, 0)), 6) AS distance
FROM duo GROUP BY ALL""",
    "topic_prevalence": f"""WITH {VOCABULARY}, {THETA}, lengths AS (
    SELECT doc_id, sum(cnt) AS length FROM bag JOIN voc USING (token) GROUP BY doc_id),
parts AS (
    SELECT topic, sum(weight * length) AS part FROM theta JOIN lengths USING (doc_id) GROUP BY topic)
SELECT topic, round(part / sum(part) OVER (), 9) AS prevalence FROM parts""",
    "coherence_cv": f"""WITH {COUNTS}, summed AS (
    SELECT topic, j, sum(v) AS s FROM npmi GROUP BY ALL),
cosines AS (
    SELECT topic, i, coalesce(sum(v * s) / nullif(sqrt(sum(v * v)) * sqrt(sum(s * s)), 0), 0) AS c
    FROM npmi JOIN summed USING (topic, j) GROUP BY ALL)
SELECT topic, round(avg(c), 6) AS coherence FROM cosines GROUP BY topic""",
    "coherence_npmi": f"""WITH {COUNTS}
SELECT topic, round(avg(v), 6) AS coherence FROM npmi WHERE i < j GROUP BY topic""",
    "exposure_long": f"""WITH {EXPOSURE}
SELECT ticker, topic, round(exposure, 9) AS exposure FROM exposure""",
    "exposure_wide": f"""WITH {EXPOSURE}
SELECT ticker, {", ".join(f"round(max(exposure) FILTER (topic = {i}), 9) AS Topic_{i}" for i in range(K))}
FROM exposure GROUP BY ticker""",
    "exposure_total": f"""WITH {EXPOSURE}
SELECT topic, round(sum(exposure), 9) AS total_exposure FROM exposure GROUP BY topic""",
    "labelled_exposure": f"""WITH {EXPOSURE}, {LABELS}
SELECT ticker, {NAME} AS label, round(exposure, 9) AS exposure
FROM exposure LEFT JOIN labels_t USING (topic)""",
    "doc_topic_normalise": f"""WITH raw AS (
    SELECT vec_id AS doc_id, unnest(range({K})) AS topic,
           greatest(unnest(list_transform(range({K}), lambda t: list_sum(list_transform(range(t + 1, len(embedding) + 1, {K}), lambda i: embedding[i]::DOUBLE)))), 1e-10) AS w FROM embeddings)
SELECT doc_id, topic, round(w / sum(w) OVER (PARTITION BY doc_id), 9) AS weight FROM raw""",
    "doc_topics_wide": f"""WITH {THETA}
SELECT doc_id, ticker, year, {", ".join(
    f"round(coalesce(max(weight) FILTER (topic = {i}), 0), 9) AS Topic_{i}" for i in range(K))}
FROM theta GROUP BY doc_id, ticker, year""",
    "unit_vectors": f"""WITH raw AS (
    SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
sums AS (
    SELECT vec_id, sqrt(sum(x * x)) AS n, max(x) FILTER (i = 0) AS x0,
           sum(x * CASE WHEN i < 4 THEN 2 * x ELSE x END) AS d,
           sqrt(sum(CASE WHEN i < 4 THEN 4 * x * x ELSE x * x END)) AS m
    FROM raw GROUP BY vec_id)
SELECT vec_id, round(n, 9) AS length, 1.0::DOUBLE AS unit_length, round(x0 / n, 9) AS first,
       round(d / (n * m), 9) AS cosine FROM sums""",
    "company_similarity": f"""WITH {NET}
SELECT src, dst, round(weight, 6) AS weight FROM sims WHERE weight > 0.75""",
    "similarity_edges": f"""WITH {NET}
SELECT src, dst, round(weight, 6) AS weight, round(weight * 4, 6) AS width FROM sims WHERE weight > 0.97""",
    "company_components": f"WITH RECURSIVE {COMPONENTS} SELECT ticker, component FROM comp",
    "companies": f"WITH {NET} SELECT DISTINCT ticker FROM net",
    "peer_components": f"""WITH RECURSIVE {COMPONENTS}, sized AS (
    SELECT ticker, component, count(*) OVER (PARTITION BY component) AS size FROM comp)
SELECT component, size, ticker FROM sized WHERE size > 1""",
    "topic_drift": f"WITH {_drift()} SELECT ticker, round(jsd, 4) AS jsd FROM drift",
    "topic_drift_bits": f"WITH {_drift('mean', '2')} SELECT ticker, round(jsd, 6) AS jsd FROM drift",
    "drift_top10": f"""WITH {_drift().replace("'T' || (vec_id % 10)", "'T' || (vec_id % 40)").replace(
        "(vec_id // 10)", "(vec_id // 40)")},
best AS (SELECT * FROM drift ORDER BY jsd DESC, ticker LIMIT 10)
SELECT ticker, round(jsd, 4) AS jsd FROM best""",
    "drift_top5": f"""WITH {_drift()}, best AS (SELECT * FROM drift ORDER BY jsd DESC, ticker LIMIT 5)
SELECT ticker, round(jsd, 4) AS jsd FROM best""",
    "drift_flags": f"""WITH {_drift()}
SELECT ticker, round(jsd, 6) AS jsd, jsd > 0.35 AS flagged FROM drift""",
    "topic_deltas": f"""WITH {_drift()}, {LABELS}
SELECT ticker, {NAME} AS label, round(q - p, 9) AS delta FROM yearly LEFT JOIN labels_t USING (topic)""",
    "drift_table": f"""WITH {_drift()}
SELECT ticker, round(any_value(jsd), 4) AS jsd, {", ".join(
    f"round(max(q - p) FILTER (topic = {i}), 4) + 0.0 AS Topic_{i}_delta" for i in range(K))}
FROM yearly JOIN drift USING (ticker) GROUP BY ticker""",
    "top_drifter_deltas": f"""WITH {_drift()}, {LABELS},
best AS (SELECT ticker FROM drift ORDER BY jsd DESC, ticker LIMIT 1)
SELECT ticker, {NAME} AS label, round(q - p, 9) AS delta, sign(q - p)::BIGINT AS sign
FROM yearly JOIN best USING (ticker) LEFT JOIN labels_t USING (topic)""",
    "cluster_sizes": """SELECT i AS cluster, count(label) AS size
FROM range(12) r(i) LEFT JOIN embeddings ON label = i GROUP BY i""",
    "cluster_representatives": f"""WITH {CENTRES}, {CLUSTER_T}, best AS (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, para_id) AS rank FROM near)
SELECT cluster::BIGINT AS cluster, rank, para_id, round(distance, 6) AS distance,
       coalesce(label, 'Unnamed Embedding Topic ' || cluster) AS label
FROM best LEFT JOIN labels_c USING (cluster) WHERE rank <= 3""",
    "silhouette_exact": f"""WITH {_silhouette("list_distance(a.v, b.v)")}
SELECT para_id, cluster::BIGINT AS cluster, round(silhouette, 6) AS silhouette FROM sil""",
    "silhouette_squared": f"""WITH {_silhouette("list_distance(a.v, b.v) ** 2")}
SELECT count(*) AS points, round(avg(silhouette), 6) AS silhouette FROM sil""",
    "cluster_choice": "WITH "
    + _silhouette(
        "list_distance(a.v, b.v)",
        """pts AS (
    SELECT vec_id + 1000000000 * k AS para_id, k * 1000 + label % k AS cluster, embedding::DOUBLE[] AS v
    FROM embeddings, range(2, 7) r(k))""",
    ).replace("FROM pts a, pts b", "FROM pts a JOIN pts b ON a.cluster // 1000 = b.cluster // 1000")
    + """, scores AS (
    SELECT cluster // 1000 AS k, avg(silhouette) AS score FROM sil GROUP BY ALL)
SELECT k, round(score, 6) AS score, score > 0.2 AS reached FROM scores ORDER BY scores.score DESC, k LIMIT 1""",
}


def _lemmas() -> str:
    rules = "\n    UNION ALL ".join(
        f"SELECT token, left(token, length(token) - {len(end)}) || '{new}' AS lemma FROM regular "
        f"WHERE suffix(token, '{end}') AND length(token) > {len(end)}"
        for end, new in NOUN_ENDINGS
    )
    irregular = ", ".join(f"('{a}', '{b}')" for a, b in IRREGULAR_NOUNS.items())
    return f"""{TOKS}, {WORDS}, plain AS (SELECT DISTINCT token FROM words),
lexicon AS (SELECT DISTINCT unnest({RAW_WORDS}) AS lemma FROM documents),
irregular(token, lemma) AS (VALUES {irregular}),
regular AS (SELECT token FROM plain WHERE token NOT IN (SELECT token FROM irregular)),
candidates AS (
    SELECT token, token AS lemma FROM plain
    UNION ALL SELECT token, lemma FROM irregular JOIN plain USING (token)
    UNION ALL {rules}),
lemmas AS (
    SELECT token, arg_min(lemma, (length(lemma), lemma)) AS lemma
    FROM candidates JOIN lexicon USING (lemma) GROUP BY token)"""


ORACLES["lemma_table"] = f"WITH {_lemmas()} SELECT token, lemma FROM lemmas WHERE token <> lemma"
ORACLES["lemmatize"] = f"""WITH {_lemmas()}, spots AS (
    SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM toks),
joined AS (
    SELECT doc_id, count(*) AS n_tokens, string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS tokens
    FROM spots LEFT JOIN lemmas USING (token) GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(joined.tokens, '') AS tokens
FROM (SELECT doc_id FROM toks) LEFT JOIN joined USING (doc_id)"""
_PIECES = f"""WITH {CORPUS}, split AS (
    SELECT doc_id, ticker, year, string_split({squeeze("text")}, chr(10)) AS parts FROM corpus),
pieces AS (
    SELECT doc_id, ticker, year, unnest(range(len(parts))) AS para_pos,
           {strip("unnest(parts)")} AS paragraph FROM split)"""
ORACLES["paragraphs"] = f"""{_PIECES}
SELECT doc_id || '-' || para_pos AS para_id, doc_id, ticker, year, para_pos, paragraph
FROM pieces WHERE length(paragraph) > 100"""
ORACLES["paragraph_excerpt"] = f"""{_PIECES}
SELECT doc_id || '-' || para_pos AS para_id, substring(paragraph, 1, 200) || '...' AS excerpt
FROM pieces WHERE length(paragraph) > 100"""
ORACLES["lemmatize_joined"] = ORACLES["lemmatize"]
ORACLES["stopword_filter_joined"] = ORACLES["stopword_filter"]
ORACLES["similarity_edges_blocked"] = ORACLES["similarity_edges"]
ORACLES["components_default"] = ORACLES["company_components"].replace("weight > 0.97", "weight > 0.75")
ORACLES["first_filings"] = f"""WITH sections AS ({
    ORACLES["filing_extract"].replace("SELECT regexp_extract(path", "SELECT path, regexp_extract(path").replace(
        "SELECT ticker, year, text,", "SELECT path, ticker, year, text,")
})
SELECT ticker, arg_min(word_count, path) FILTER (year = 2023)::DOUBLE AS before,
       arg_min(word_count, path) FILTER (year = 2024)::DOUBLE AS after
FROM sections GROUP BY ticker HAVING count(DISTINCT year) = 2"""
ORACLES["doc_topics_check"] = """
SELECT count(*) AS documents, 5::BIGINT AS topics, count(*) AS whole FROM documents"""
ORACLES["lda_model_check"] = f"""WITH {VOCABULARY}
SELECT count(*) AS terms, 5::BIGINT AS topics, 5::BIGINT AS whole, 14::BIGINT AS rising FROM voc"""
ORACLES["kmeans_check"] = "SELECT count(*) AS points, count(*) AS nearest FROM embeddings"
ORACLES["paragraph_vectors_check"] = f"""{_PIECES}
SELECT count(*) AS paragraphs, count(*) AS whole FROM pieces WHERE length(paragraph) > 100"""
ORACLES["comparison_report"] = f"""WITH {LANG_TOPICS}, {LABELS}, {CENTRES}, {CLUSTER_T}, best AS (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, para_id) AS rank FROM near),
texts AS (
    SELECT cluster, rank, substring(text, 1, 200) || '...' AS summary
    FROM best JOIN documents ON doc_id = para_id WHERE rank <= 2),
sizes AS (SELECT i AS cluster, count(label) AS size FROM range(12) r(i) LEFT JOIN embeddings ON label = i GROUP BY i)
SELECT 'lda' AS method, topic AS id, {NAME} AS label, NULL::BIGINT AS size, 1::BIGINT AS rank,
       string_agg(printf('%.3f', weight) || '*"' || term || '"', ' + ' ORDER BY ranked.rank) AS summary
FROM ranked LEFT JOIN labels_t USING (topic) WHERE ranked.rank <= 10 GROUP BY topic, label
UNION ALL
SELECT 'kmeans', cluster, coalesce(label, 'Unnamed Embedding Topic ' || cluster), size, rank, summary
FROM sizes LEFT JOIN texts USING (cluster) LEFT JOIN labels_c USING (cluster)"""
ORACLES["filing_tree_round_trip"] = ORACLES["filing_extract"]
ORACLES["flat_files_round_trip"] = ORACLES["flat_filings"]
ORACLES["similarity_classes"] = f"WITH {NET} SELECT src, dst FROM sims WHERE weight > 0.75"
ORACLES["paragraph_svd_check"] = ORACLES["paragraph_vectors_check"]
ORACLES["encoded_paragraphs"] = f"""{_PIECES}, counts AS (
    SELECT doc_id || '-' || para_pos AS para_id, list_transform(string_split('aeinorst', ''),
        lambda c: (length(paragraph) - length(replace(paragraph, c, '')))::DOUBLE) AS n
    FROM pieces WHERE length(paragraph) > 100)
SELECT para_id, CASE WHEN list_sum(n) = 0 THEN 0.0
    ELSE round(list_sum(n) / sqrt(list_sum(list_transform(n, lambda x: x * x))), 6) END::DOUBLE AS total,
    (list_sum(n) > 0)::INT::DOUBLE AS length
FROM counts"""
