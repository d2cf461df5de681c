"""The derived meeting tables as SQL, for the checks of queries."""

VIEWS = {
    "conv_turns": """conv_norm AS (SELECT conv_id AS job_id, turn, role AS speaker, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text FROM conversations),
conv_n AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END::BIGINT AS n_words FROM conv_norm),
conv_d AS (SELECT *, 400 * n_words + 800 * (n_words // 11) AS dur_ms FROM conv_n),
conv_turns AS (SELECT *, start_ms + dur_ms AS end_ms FROM (SELECT *, coalesce(sum(dur_ms + 700) OVER (PARTITION BY job_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM conv_d))""",
    "words": """wx AS (SELECT job_id, start_ms AS t, unnest(string_split(text, ' ')) AS word, unnest(range(n_words)) AS ix FROM conv_turns WHERE n_words > 0),
words AS (SELECT job_id, s // 90000 AS chunk_ix, s AS pos, word, s AS start_ms, s + 300 AS end_ms FROM (SELECT *, t + 400 * ix + 800 * (ix // 11) AS s FROM wx))""",
    "turns": """turns AS (SELECT * FROM (SELECT job_id, turn AS turn_ix, speaker, start_ms + CASE WHEN turn % 3 = 1 THEN 1000 ELSE 0 END + CASE WHEN turn % 4 = 3 THEN 6000 ELSE 0 END AS start_ms,
  end_ms + CASE WHEN turn % 2 = 1 THEN 1500 ELSE 0 END AS end_ms FROM conv_turns) WHERE end_ms > start_ms)""",
    "utts": """utts AS (SELECT *, sum(CASE WHEN gap >= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, chunk_ix ORDER BY pos)::BIGINT AS utt
  FROM (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY job_id, chunk_ix ORDER BY pos) AS gap FROM words))""",
    "spoken": """ov AS (SELECT u.job_id, u.chunk_ix, u.utt, t.speaker, least(u.end_ms, t.end_ms) - greatest(u.start_ms, t.start_ms) AS o, u.pos, t.turn_ix
  FROM utts u JOIN turns t ON u.job_id = t.job_id AND u.start_ms < t.end_ms AND t.start_ms < u.end_ms),
sh AS (SELECT job_id, chunk_ix, utt, speaker, sum(o) AS shared, min(pos * 1000 + turn_ix) AS f FROM ov WHERE o > 0 GROUP BY ALL),
win AS (SELECT job_id, chunk_ix, utt, speaker FROM (SELECT *, row_number() OVER (PARTITION BY job_id, chunk_ix, utt ORDER BY shared DESC, f) AS rn FROM sh) WHERE rn = 1),
spoken AS (SELECT u.job_id, u.chunk_ix, u.pos, u.word, u.start_ms, u.end_ms, u.utt, coalesce(w.speaker, 'UNKNOWN') AS speaker FROM utts u LEFT JOIN win w USING (job_id, chunk_ix, utt))""",
    "segs": """segw AS (SELECT *, sum(ch) OVER (PARTITION BY job_id, chunk_ix ORDER BY pos)::BIGINT AS seg_ix FROM
  (SELECT *, CASE WHEN speaker <> lag(speaker) OVER (PARTITION BY job_id, chunk_ix ORDER BY pos) THEN 1 ELSE 0 END AS ch FROM spoken)),
segs AS (SELECT job_id, chunk_ix, seg_ix, first(speaker) AS speaker, CASE WHEN first(speaker) = 'UNKNOWN' THEN 0.0 ELSE 1.0 END::DOUBLE AS speaker_confidence,
  min(start_ms) AS start_ms, arg_max(end_ms, pos) AS end_ms, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n_words FROM segw GROUP BY job_id, chunk_ix, seg_ix)""",
    "lines": """la AS (SELECT *, chunk_ix * 100000 + seg_ix AS seg_no FROM segw),
lb AS (SELECT *, lag(speaker) OVER j AS sb, lag(seg_no) OVER j AS gb, lag(end_ms) OVER j AS eb, lag(word) OVER j AS wb FROM la WINDOW j AS (PARTITION BY job_id ORDER BY seg_no, pos)),
lc AS (SELECT *, sum(CASE WHEN sb IS NULL OR speaker <> sb THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seg_no, pos) AS run, (gb IS NULL OR seg_no <> gb) AS opens FROM lb),
li AS (SELECT *, greatest(0, start_ms - eb) AS gap FROM lc WHERE NOT opens),
lj AS (SELECT *, (regexp_matches(wb, '[.!?]$') OR (count(gap) OVER p >= 5 AND gap >= greatest(600.0, quantile_cont(gap, 0.9) OVER p))) AS br FROM li
  WINDOW p AS (PARTITION BY job_id, run ORDER BY seg_no, pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
lk AS (SELECT job_id, seg_no, pos, speaker, word, start_ms, end_ms, coalesce(br, false) AS br FROM lj UNION ALL SELECT job_id, seg_no, pos, speaker, word, start_ms, end_ms, true FROM lc WHERE opens),
ll AS (SELECT *, sum(br::INT) OVER (PARTITION BY job_id ORDER BY seg_no, pos)::BIGINT - 1 AS line_no FROM lk),
lines AS (SELECT job_id, line_no, first(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY seg_no, pos) AS text FROM ll GROUP BY job_id, line_no)""",
    "big_turns": """big_turns AS (SELECT job_id, turn_ix, speaker, 60000 * turn_ix AS start_ms, 60000 * turn_ix + (1000 * q)::BIGINT AS end_ms FROM (SELECT l_orderkey AS job_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS turn_ix, 'SPEAKER_' || (l_suppkey % 4) AS speaker, l_quantity AS q FROM lineitem))""",
    "members": """members AS (SELECT 'test:64' AS namespace, 'voice_' || label AS name, vec_id // 10 AS job_id, 'SPEAKER_' || (vec_id % 10) AS speaker_id, embedding::DOUBLE[] AS embedding, vec_id AS added FROM embeddings WHERE vec_id % 5 <> 0)""",
    "prints": """prints AS (SELECT vec_id AS print_id, vec_id // 10 AS job_id, 'SPEAKER_' || (vec_id % 10) AS speaker_id, embedding::DOUBLE[] AS embedding FROM embeddings WHERE vec_id % 5 = 0)""",
    "voices": """un AS (SELECT name, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS e FROM members),
ud AS (SELECT name, unnest(e) AS x, unnest(range(len(e))) AS d FROM un),
um AS (SELECT name, d, sum(x) / count(*) AS x FROM ud GROUP BY name, d),
uv AS (SELECT name, list(x ORDER BY d) AS v FROM um GROUP BY name),
voices AS (SELECT name, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS centroid FROM uv)""",
    "matches": """mx AS (SELECT p.print_id, p.job_id, p.speaker_id, v.name, list_cosine_similarity(p.embedding, v.centroid) AS score FROM prints p, voices v),
matches AS (SELECT print_id, job_id, speaker_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY print_id ORDER BY score DESC, name) AS rn FROM mx) WHERE rn = 1)""",
    "recordings": """recordings AS (SELECT doc_id AS job_id, sha256(text) AS fingerprint, source AS dir, lang, doc_id AS mtime, doc_id % 4 <> 0 AS transcribed, length(text)::BIGINT AS size FROM documents)""",
    "live": """live AS (SELECT user_id AS recording, CASE WHEN event_type IN ('click', 'view') THEN 'mic' ELSE 'system' END AS track, event_id, event_type,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 AS start_ms, floor(1000 * value / max(value) OVER (PARTITION BY user_id))::BIGINT AS p_milli FROM events)""",
}
VIEWS["pieces"] = """px AS (SELECT job_id, turn, speaker, n_words, start_ms AS t, unnest(range((n_words - 1) // 11 + 1)) AS k FROM conv_turns WHERE n_words > 0),
pieces AS (SELECT job_id AS recording, turn, k, CASE WHEN speaker = 'user' THEN 'mic' ELSE 'system' END AS track, speaker AS voice, t AS turn_start, s AS seq, s AS start_ms, s + 400 * least(11, n_words - 11 * k) - 100 AS end_ms FROM (SELECT *, t + 5200 * k AS s FROM px))"""
NEEDS = {
    "pieces": ["conv_turns"],
    "words": ["conv_turns"], "turns": ["conv_turns"], "utts": ["words"], "spoken": ["utts", "turns"], "segs": ["spoken"], "lines": ["segs"], "voices": ["members"], "matches": ["prints", "voices"],
}


def sql(body: str, *views: str) -> str:
    """The body with the views that it names, and what they need, before it."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, []):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    return "WITH " + ",\n".join(VIEWS[v] for v in order) + "\n" + body if order else body
