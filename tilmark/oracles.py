"""The same queries in SQL for DuckDB, over the test tables."""

from __future__ import annotations

from tilmark.functions import text
from tilmark.operators.align import THRESHOLD
from tilmark.operators.segment import PRE_ROLL, SILENCE_LIMIT
from tilmark.plans.tables import DRESS, SPEECH_ABOVE, VOWELS

SPACE = text.SPACE


def dressed(t: str) -> str:
    return f"translate({t}, '{VOWELS}', '{DRESS}')"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g'), ' ')"


def norm(t: str) -> str:
    return collapse(f"translate({t}, '{text._FROM}', '{text._TO}')")


def stripped(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{SPACE}+'), lambda w: w <> '')"


def chars(t: str) -> str:
    return f"list_filter(string_split({t}, ''), lambda w: w <> '')"


def distances(a: str, b: str, keep: bool = False) -> str:
    """The last row of the table of Levenshtein distances between lists, or all rows."""
    row = "p[-1]" if keep else "p"
    cell = f"CASE WHEN {b}[j] = x THEN {row}[j] ELSE 1 + least({row}[j], {row}[j + 1], q[-1]) END"
    made = f"list_reduce(range(1, len({b}) + 1), lambda q, j: list_append(q, {cell}), [{row}[1] + 1])"
    first = f"range(0, len({b}) + 1)"
    return f"list_reduce({a}, lambda p, x: {f'list_append(p, {made})' if keep else made}, {f'[{first}]' if keep else first})"


def lcs(a: str, b: str) -> str:
    cell = f"CASE WHEN {b}[j] = x THEN p[j] + 1 ELSE greatest(p[j + 1], q[-1]) END"
    made = f"list_reduce(range(1, len({b}) + 1), lambda q, j: list_append(q, {cell}), [0::BIGINT])"
    return f"list_reduce({a}, lambda p, x: {made}, list_transform(range(0, len({b}) + 1), lambda z: 0::BIGINT))[-1]"


def rate(a: str, b: str) -> str:
    return f"CASE WHEN len({b}) = 0 THEN CASE WHEN len({a}) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE ELSE {distances(a, b)}[-1] / len({b}) END"


CORPUS = f"""
verses AS (
  SELECT item_id AS idx, CAST(item_id // 10 + 1 AS INT) AS surah, CAST(item_id % 10 + 1 AS INT) AS ayah, {norm(dressed('text'))} AS plain, {dressed('text')} AS original
  FROM benchmark
)"""
HYPS = f"""{CORPUS}, said AS (
  SELECT idx, surah, ayah, i, CASE WHEN i % 7 = 3 THEN [] WHEN i % 5 = 2 THEN [reverse(w[i])] WHEN i % 11 = 6 THEN [w[i], w[i]] ELSE [w[i]] END AS s
  FROM (SELECT *, {words('plain')} AS w FROM verses), unnest(range(1, len(w) + 1)) AS u(i)
), hyps AS (SELECT idx AS hyp_id, surah, ayah, {norm("array_to_string(flatten(list(s ORDER BY i)), ' ')")} AS hyp FROM said GROUP BY ALL
), pairs AS (
  SELECT hyp_id, hyps.surah, hyps.ayah, hyp, plain AS ref, original, {words('hyp')} AS hw, {words('plain')} AS rw FROM hyps JOIN verses USING (surah, ayah)
)"""
TURNS = f"""
turns AS (
  SELECT conv_id, turn, {norm(dressed('text'))} AS hyp,
         {norm(dressed("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text), '')"))} AS ref FROM conversations
), split AS (SELECT conv_id, turn, {words('hyp')} AS hw, {words('ref')} AS rw FROM turns)"""
#: scored needs a relation `asked` (hyp_id, idx, a, b): it gives the token-set score of each pair.
SCORED = f"""
sets AS (SELECT *, list_distinct({words('a')}) AS p, list_distinct({words('b')}) AS q FROM asked),
parts AS (
  SELECT *, list_intersect(p, q) AS i, array_to_string(list_sort(list_filter(p, lambda t: NOT list_contains(q, t))), ' ') AS x,
         array_to_string(list_sort(list_filter(q, lambda t: NOT list_contains(p, t))), ' ') AS y FROM sets
), sizes AS (SELECT *, length(x) AS la, length(y) AS lb, length(array_to_string(i, ' ')) AS sl, CASE WHEN len(i) > 0 THEN 1 ELSE 0 END AS g, {chars('x')} AS xc, {chars('y')} AS yc FROM parts),
drawn AS (
  SELECT *, 100.0::DOUBLE - 100.0::DOUBLE * (la + lb - 2 * CASE WHEN la = 0 OR lb = 0 THEN 0 ELSE {lcs('xc', 'yc')} END) / (2 * (sl + g) + la + lb) AS r1,
         100.0::DOUBLE - 100.0::DOUBLE * (g + la) / (2 * sl + g + la) AS r2, 100.0::DOUBLE - 100.0::DOUBLE * (g + lb) / (2 * sl + g + lb) AS r3 FROM sizes
), scored AS (
  SELECT hyp_id, idx, CASE WHEN len(p) = 0 OR len(q) = 0 THEN 0.0::DOUBLE WHEN len(i) > 0 AND (la = 0 OR lb = 0) THEN 100.0::DOUBLE
         WHEN sl = 0 THEN r1 ELSE greatest(r1, r2, r3) END AS score FROM drawn
)"""
STEPS = f"""{HYPS}, tables AS (SELECT *, {distances('rw', 'hw', keep=True)} AS t FROM pairs),
back AS (
  SELECT hyp_id, 0 AS step, len(rw) AS i, len(hw) AS j, '' AS status, '' AS h, '' AS r, '' AS d FROM tables
  UNION ALL
  SELECT hyp_id, step + 1, i - (kind <> 'insertion')::INT, j - (kind <> 'deletion')::INT, kind,
         CASE WHEN kind = 'deletion' THEN '' ELSE hw[j] END, CASE WHEN kind = 'insertion' THEN '' ELSE rw[i] END, CASE WHEN kind = 'insertion' THEN '' ELSE dw[i] END
  FROM (
    SELECT back.hyp_id, step, i, j, hw, rw, {words('original')} AS dw,
           CASE WHEN i > 0 AND j > 0 AND rw[i] = hw[j] THEN 'correct' WHEN i > 0 AND j > 0 AND t[i + 1][j + 1] = t[i][j] + 1 THEN 'substitution'
                WHEN i > 0 AND t[i + 1][j + 1] = t[i][j + 1] + 1 THEN 'deletion' ELSE 'insertion' END AS kind
    FROM back JOIN tables USING (hyp_id) WHERE i > 0 OR j > 0
  )
), aligned AS (SELECT *, row_number() OVER (PARTITION BY hyp_id ORDER BY step DESC) - 1 AS place FROM back WHERE step > 0)"""
STREAMS = "user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq"
ONE_STREAM = "CAST(0 AS BIGINT) AS s, event_id AS seq"
CLOSED = "SELECT a.s, a.seq AS start, b.seq AS stop FROM counted a JOIN"
CLOSED_OR_LAST = "SELECT a.s, a.seq AS start, coalesce(b.seq, (SELECT max(z.seq) FROM counted z WHERE z.s = a.s)) AS stop FROM counted a LEFT JOIN"
FRAMES = f"""
frames AS (SELECT {STREAMS}, event_id, value > {SPEECH_ABOVE} AS speech FROM events),
counted AS (SELECT *, sum((NOT speech)::INT) OVER (PARTITION BY s ORDER BY seq) AS ns FROM frames),
spans AS (
  {CLOSED} counted b ON a.s = b.s AND NOT b.speech AND b.ns = a.ns + {SILENCE_LIMIT} WHERE a.speech
), linked AS (SELECT a.s, a.start, a.stop, min(f.seq) AS nxt FROM spans a LEFT JOIN counted f ON f.s = a.s AND f.speech AND f.seq > a.stop GROUP BY ALL),
chain AS (
  SELECT l.s, l.start, l.stop, l.nxt, 0 AS n FROM linked l JOIN (SELECT s, min(seq) AS seq FROM counted WHERE speech GROUP BY s) f ON l.s = f.s AND l.start = f.seq
  UNION ALL
  SELECT l.s, l.start, l.stop, l.nxt, c.n + 1 FROM chain c JOIN linked l ON l.s = c.s AND l.start = c.nxt
), idle AS (
  SELECT c.s, c.n, f.seq, f.event_id, row_number() OVER (PARTITION BY c.s, c.n ORDER BY f.seq DESC) AS back
  FROM chain c JOIN counted f ON f.s = c.s AND NOT f.speech AND f.seq < c.start
  WHERE NOT EXISTS (SELECT 1 FROM chain e WHERE e.s = c.s AND f.seq BETWEEN e.start AND e.stop)
), held AS (
  SELECT s, n, seq, event_id FROM idle WHERE back <= {PRE_ROLL}
  UNION ALL SELECT c.s, c.n, f.seq, f.event_id FROM chain c JOIN counted f ON f.s = c.s AND f.seq BETWEEN c.start AND c.stop
)"""


def _best(scope: bool, threshold: float) -> str:
    on = "hyps.surah = verses.surah" if scope else "true"
    return f"""{HYPS}, asked AS (SELECT hyp_id, idx, hyp AS a, plain AS b FROM hyps JOIN verses ON {on}), {SCORED},
won AS (SELECT * FROM scored WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY hyp_id ORDER BY score DESC, idx) = 1)"""


def _chunks(cut: str, end: str) -> str:
    return f"""
SELECT vec_id, CAST(k AS INT) AS chunk, CAST({end} - a AS INT) AS n, e[a + 1] AS first_sample, e[{end}] AS last_sample
FROM (SELECT vec_id, embedding::FLOAT[] AS e FROM embeddings), {cut}"""


def oracle_sql() -> dict[str, str]:
    from tilmark.queries import CHUNK, OVERLAP, STUB_STEP, STUB_WORDS
    from tilmark.sources.audio_files import ROLLOFF as SINC_ROLLOFF
    from tilmark.sources.audio_files import WIDTH as SINC_WIDTH

    step = CHUNK - OVERLAP
    exact = f"{HYPS}, asked AS (SELECT hyp_id, hyp_id AS idx, hyp AS a, ref AS b FROM pairs), {SCORED}"
    hc, rc = chars("replace(hyp, ' ', '')"), chars("replace(ref, ' ', '')")
    turn_accuracy = f"WITH {TURNS}, rates AS (SELECT conv_id, turn, (1 - {rate('hw', 'rw')}) * 100 AS accuracy FROM split)"
    segments = f"""WITH RECURSIVE {FRAMES} SELECT s AS stream_id, CAST(n AS INT) AS segment_no, c.start AS start_seq, c.stop AS end_seq, CAST(count(*) AS INT) AS n_frames,
       hex(encode(string_agg(CAST(event_id AS VARCHAR), '' ORDER BY seq))) AS raw_hex FROM held JOIN chain c USING (s, n) GROUP BY ALL"""
    clean = stripped("replace('  ' || text || ' ۝ ', '۝', '')")
    return {
        "norm_full": f"SELECT doc_id, {norm(dressed('text'))} AS plain FROM documents",
        "norm_steps": f"""SELECT conv_id, turn, translate(t, '{text.MARKS}', '') AS no_marks, translate(t, '{text.ALEF_VARIANTS}', '{text.ALEF * 4}') AS alef,
            replace(t, '{text.WAW_HAMZA}', '{text.WAW}') AS waw, replace(t, '{text.ALEF_MAQSURA}', '{text.YA}') AS ya, replace(t, '{text.TATWEEL}', '') AS no_tatweel,
            {collapse('t')} AS spaces, {stripped('t')} AS stripped, replace(text, ' ', '') AS joined FROM (SELECT *, {dressed('text')} AS t FROM conversations)""",
        "tokenise": f"""SELECT doc_id, CAST(len(w) AS INT) AS n_words, w[1] AS first_word, w[-1] AS last_word, CAST(len(list_distinct(w)) AS INT) AS n_distinct
            FROM (SELECT doc_id, {words(dressed('text'))} AS w FROM documents)""",
        "strip_end_of_ayah": f"SELECT conv_id, turn, {clean} AS clean FROM conversations",
        "wer": f"WITH {TURNS} SELECT conv_id, turn, {rate('hw', 'rw')} AS wer FROM split",
        "accuracy": f"{turn_accuracy} SELECT conv_id, turn, accuracy, format('{{:.1f}}', accuracy) AS shown FROM rates",
        "micro_wer": f"WITH {TURNS} SELECT sum({distances('hw', 'rw')}[-1]) / sum(len(rw)) AS wer FROM split",
        "cer": f"WITH {HYPS}, c AS (SELECT hyp_id, {hc} AS h, {rc} AS r FROM pairs) SELECT hyp_id, {rate('h', 'r')} AS cer FROM c",
        "indel_ratio": f"""WITH {HYPS}, c AS (SELECT hyp_id, {chars('hyp')} AS h, {chars('ref')} AS r FROM pairs)
            SELECT hyp_id, 100.0::DOUBLE - 100.0::DOUBLE * (len(h) + len(r) - 2 * {lcs('h', 'r')}) / (len(h) + len(r)) AS ratio FROM c""",
        "word_ratio": f"""WITH {CORPUS}, c AS (
              SELECT idx, CAST(i - 1 AS INT) AS place, {chars('w[i]')} AS h, {chars('w[i + 1]')} AS r FROM (SELECT idx, {words('plain')} AS w FROM verses), unnest(range(1, len(w))) AS u(i)
            ) SELECT idx, place, 100.0::DOUBLE - 100.0::DOUBLE * (len(h) + len(r) - 2 * {lcs('h', 'r')}) / (len(h) + len(r)) AS ratio FROM c""",
        "token_set": f"WITH {exact} SELECT hyp_id, score FROM scored",
        "fuzzy_top1_scoped": f"WITH {_best(True, THRESHOLD)} SELECT hyp_id, won.idx, score AS match_score FROM hyps LEFT JOIN won USING (hyp_id)",
        "fuzzy_top1_global": f"WITH {_best(False, THRESHOLD)} SELECT hyp_id, won.idx, score AS match_score FROM hyps LEFT JOIN won USING (hyp_id)",
        "fuzzy_top1_blocks": f"WITH {_best(False, THRESHOLD)} SELECT hyp_id, won.idx, score AS match_score FROM hyps LEFT JOIN won USING (hyp_id)",
        "below_threshold": f"""WITH {_best(True, 80.0)} SELECT hyp_id, CASE WHEN won.idx IS NULL THEN 'below_threshold' ELSE 'matched' END AS match_status, v.surah, v.ayah
            FROM hyps LEFT JOIN won USING (hyp_id) LEFT JOIN verses v ON v.idx = won.idx""",
        "exact_match": f"""WITH {exact}, c AS (SELECT *, {hc} AS h, {rc} AS r FROM pairs)
            SELECT hyp_id, 'exact' AS match_status, surah, ayah, {rate('hw', 'rw')} AS wer, {rate('h', 'r')} AS cer, score AS match_score FROM c JOIN scored USING (hyp_id)""",
        "not_found": f"""WITH {HYPS} SELECT hyps.hyp_id, CASE WHEN v.idx IS NULL THEN 'not_found' ELSE 'exact' END AS match_status, hyps.surah, CAST(hyps.ayah + 5 AS INT) AS ayah,
            CASE WHEN v.idx IS NOT NULL THEN {rate(words('hyp'), words('v.plain'))} END AS wer
            FROM hyps LEFT JOIN verses v ON v.surah = hyps.surah AND v.ayah = hyps.ayah + 5""",
        "align_words": (aligned := f"""WITH RECURSIVE {STEPS}, c AS (SELECT *, {chars('h')} AS hc, {chars('r')} AS rc FROM aligned)
            SELECT hyp_id, CAST(place AS INT) AS place, h AS hyp_word, r AS ref_word, d AS ref_word_with_diac, status,
              CASE status WHEN 'correct' THEN 1.0::DOUBLE WHEN 'substitution' THEN (100.0::DOUBLE - 100.0::DOUBLE * (len(hc) + len(rc) - 2 * {lcs('hc', 'rc')}) / (len(hc) + len(rc))) / 100 ELSE 0.0 END AS similarity FROM c"""),
        "align_words_sql": aligned,
        "align_counts": f"""WITH RECURSIVE {STEPS} SELECT hyp_id, {", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("correct", "substitution", "deletion", "insertion"))}, count(*) AS total
            FROM aligned GROUP BY hyp_id""",
        "correct_words": f"WITH RECURSIVE {STEPS} SELECT hyp_id, coalesce(string_agg(d, '|' ORDER BY place) FILTER (status = 'correct'), '') AS words FROM aligned GROUP BY hyp_id",
        "error_words": f"WITH RECURSIVE {STEPS} SELECT hyp_id, coalesce(string_agg(h, '|' ORDER BY place) FILTER (status <> 'correct'), '') AS words FROM aligned GROUP BY hyp_id",
        "report_line": f"""WITH RECURSIVE {STEPS}, asked AS (SELECT hyp_id, hyp_id AS idx, hyp AS a, ref AS b FROM pairs), {SCORED},
            c AS (SELECT *, {hc} AS h, {rc} AS r FROM pairs), rates AS (SELECT *, {rate('hw', 'rw')} AS wer, {rate('h', 'r')} AS cer FROM c JOIN scored USING (hyp_id)),
            marks AS (
              SELECT hyp_id, count(*) AS total, count(*) FILTER (status = 'correct') AS good,
                string_agg(CASE status WHEN 'correct' THEN '[' || d || ']' WHEN 'substitution' THEN '(' || h || '->' || d || ')' WHEN 'deletion' THEN '<' || d || '>' ELSE '{{' || h || '}}' END, '  ' ORDER BY place) AS m
              FROM aligned GROUP BY hyp_id
            ) SELECT hyp_id, concat_ws(chr(10), '', repeat('=', 60), '  ALIGNMENT RESULT', repeat('=', 60), '  Surah ' || surah || ', Ayah ' || ayah, repeat('-', 60),
              '  Ground truth (with tashkeel):', '    ' || original, '', '  Your recitation (transcribed):', '    ' || hyp, repeat('-', 60),
              '  Match Score  : ' || format('{{:.0f}}', score) || ' / 100', '  Word Accuracy: ' || format('{{:.1f}}', (1 - wer) * 100) || '%', '  WER          : ' || format('{{:.1f}}', wer * 100) || '%',
              '  CER          : ' || format('{{:.1f}}', cer * 100) || '%', '  Correct Words: ' || good || ' / ' || total, repeat('-', 60),
              '  Word alignment:  [correct]  (substitution)  <deletion>  {{insertion}}', '', '  ' || m, repeat('=', 60), '') AS report FROM rates JOIN marks USING (hyp_id)""",
        "corpus_flatten": f"WITH {CORPUS} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, surah, ayah, plain, original FROM verses",
        "corpus_file": f"WITH {CORPUS} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, surah, ayah, plain, original FROM verses",
        "corpus_scan": "SELECT CAST(conv_id AS INT) AS surah, CAST(turn AS INT) AS ayah, arg_max(text, text) AS original FROM conversations GROUP BY conv_id, turn",
        "corpus_counts": f"WITH {CORPUS} SELECT count(DISTINCT surah) + 1 AS surahs, count(*) AS ayahs FROM verses",
        "ayahs_per_surah": f"WITH {CORPUS} SELECT surah, count(*) AS ayahs FROM verses GROUP BY surah",
        "surah_lookup": f"WITH {CORPUS} SELECT ayah, original FROM verses WHERE surah = 2",
        "verse_lookup": f"WITH {HYPS} SELECT hyp_id, hyps.surah, CAST(hyps.ayah + 3 AS INT) AS ayah, v.original FROM hyps LEFT JOIN verses v ON v.surah = hyps.surah AND v.ayah = hyps.ayah + 3",
        "api_parse": f"SELECT CAST(conv_id AS INT) AS surah, CAST(turn AS INT) AS ayah, {stripped('arg_max(text, text)')} AS original FROM conversations GROUP BY conv_id, turn",
        "peak_normalise": """SELECT vec_id, CAST(i - 1 AS INT) AS place, CASE WHEN m > 0 THEN e[i] * (0.95::FLOAT / m) ELSE e[i] END AS sample
            FROM (SELECT vec_id, embedding::FLOAT[] AS e, list_max(list_transform(embedding::FLOAT[], lambda x: abs(x))) AS m FROM embeddings), unnest(range(1, len(e) + 1)) AS u(i)""",
        "peak": "SELECT vec_id, list_max(list_transform(embedding::FLOAT[], lambda x: abs(x))) AS peak FROM embeddings",
        "duration": "SELECT vec_id, len(embedding) / 16000.0::DOUBLE AS seconds FROM embeddings",
        "min_duration": "SELECT doc_id, CAST(len(string_split(text, ' ')) AS INT) AS n FROM documents WHERE len(string_split(text, ' ')) >= 300",
        "downmix": """SELECT vec_id, CAST(i - 1 AS INT) AS place, CAST((e[i]::DOUBLE + e[i + 32]::DOUBLE) / 2 AS FLOAT) AS sample
            FROM (SELECT vec_id, embedding::FLOAT[] AS e FROM embeddings), unnest(range(1, 33)) AS u(i)""",
        "chunks_tumbling": _chunks(f"unnest(range(0, (len(e) + {CHUNK} - 1) // {CHUNK})) AS u(k), (SELECT k * {CHUNK} AS a)", f"least(a + {CHUNK}, len(e))"),
        "chunks_overlap": _chunks(f"unnest(range(0, 1 + greatest(0, (len(e) - {CHUNK} + {step} - 1) // {step}))) AS u(k), (SELECT k * {step} AS a)", f"least(a + {CHUNK}, len(e))"),
        "pcm_decode": """SELECT p_partkey, CAST(i AS INT) AS place, CAST(((lo + 256 * hi + 32768) % 65536 - 32768) / 32768.0 AS FLOAT) AS sample FROM (
              SELECT p_partkey, i, CAST('0x' || h[4 * i + 1 : 4 * i + 2] AS INT) AS lo, CAST('0x' || h[4 * i + 3 : 4 * i + 4] AS INT) AS hi
              FROM (SELECT p_partkey, hex(encode(p_name)) AS h FROM part), unnest(range(0, length(h) // 4)) AS u(i))""",
        "resample": f"""WITH w AS (SELECT vec_id, embedding::FLOAT[] AS e FROM embeddings), taps AS (
              SELECT p, k, CASE WHEN t = 0 THEN 1.0 ELSE sin(pi() * t) / (pi() * t) END * cos(t * pi() / {2 * SINC_WIDTH}) ** 2 * {SINC_ROLLOFF}::DOUBLE AS v
              FROM (SELECT p, k, greatest(-{SINC_WIDTH}, least({SINC_WIDTH}, (k - p / 2.0::DOUBLE) * {SINC_ROLLOFF}::DOUBLE)) AS t FROM range(0, 2) AS a(p), range(-7, 8) AS b(k))
            ) SELECT vec_id, CAST(2 * i + p AS INT) AS place, round(CAST(CAST(sum(coalesce(CASE WHEN i + k >= 0 THEN e[i + k + 1] END, 0)::DOUBLE * v) AS FLOAT) AS DOUBLE), 5) AS sample
            FROM w, unnest(range(0, len(e))) AS u(i), taps GROUP BY vec_id, i, p""",
        "wav_chunks": f"""WITH e AS (
              SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, CAST(((event_id * 7919 % 60000 - 30000) * CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) / 32768.0 AS FLOAT) AS x FROM events
            ), taps AS (
              SELECT p, k, CASE WHEN t = 0 THEN 1.0 ELSE sin(pi() * t) / (pi() * t) END * cos(t * pi() / {2 * SINC_WIDTH}) ** 2 * {SINC_ROLLOFF}::DOUBLE AS v
              FROM (SELECT p, k, greatest(-{SINC_WIDTH}, least({SINC_WIDTH}, (k - p / 2.0::DOUBLE) * {SINC_ROLLOFF}::DOUBLE)) AS t FROM range(0, 2) AS a(p), range(-7, 8) AS b(k))
            ), y AS (SELECT 2 * e.i + p AS o, CAST(sum(coalesce(f.x, 0)::DOUBLE * v) AS FLOAT) AS x FROM e, taps LEFT JOIN e f ON f.i = e.i + k GROUP BY ALL),
            z AS (SELECT o, x * (0.95::FLOAT / max(abs(x)) OVER ()) AS x, count(*) OVER () AS n FROM y)
            SELECT CAST(c AS BIGINT) AS chunk, CAST(c * 900 AS BIGINT) AS start, CAST(o - c * 900 AS INT) AS place, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS sample
            FROM z, unnest(range(greatest(0, (o - 100) // 900), o // 900 + 1)) AS u(c) WHERE o - c * 900 < 1000 AND (c = 0 OR (c - 1) * 900 + 1000 < n)""",
        "wav_decode": """SELECT p_partkey, CAST(NULL AS VARCHAR) AS error, CAST(i AS INT) AS place, CAST((l::FLOAT + r::FLOAT) / 2 AS FLOAT) AS sample FROM (
              SELECT p_partkey, i, (s[2 * i + 1] + 32768) % 65536 - 32768 AS li, CAST(((s[2 * i + 1] + 32768) % 65536 - 32768) / 32768.0 AS FLOAT) AS l, CAST(((s[2 * i + 2] + 32768) % 65536 - 32768) / 32768.0 AS FLOAT) AS r
              FROM (SELECT p_partkey, list_transform(range(0, 64), lambda j: CAST('0x' || h[4 * j + 1 : 4 * j + 2] AS INT) + 256 * CAST('0x' || h[4 * j + 3 : 4 * j + 4] AS INT)) AS s
                    FROM (SELECT p_partkey, rpad(hex(encode(p_name)), 256, '0') AS h FROM part)), unnest(range(0, 32)) AS u(i))""",
        "transcribe_stub": f"""WITH steps AS (
              SELECT vec_id, e, c, s, list_avg(list_transform(e[s + 1 : least(s + {STUB_STEP}, c + {CHUNK}, len(e))], lambda x: abs(x::DOUBLE))) AS m
              FROM (SELECT vec_id, embedding::FLOAT[] AS e FROM embeddings), unnest(range(0, len(e), {CHUNK})) AS u(c), unnest(range(c, least(c + {CHUNK}, len(e)), {STUB_STEP})) AS w(s)
            ), said AS (SELECT vec_id, string_agg({STUB_WORDS!r}[CAST(floor(m * {len(STUB_WORDS)}) AS INT) % {len(STUB_WORDS)} + 1], ' ' ORDER BY s) AS text FROM steps GROUP BY vec_id)
            SELECT vec_id, coalesce(text, '') AS text, len(embedding) / 16000.0::DOUBLE AS duration_s, CAST((len(embedding) + {CHUNK - 1}) // {CHUNK} AS INT) AS n_chunks FROM embeddings LEFT JOIN said USING (vec_id)""",
        "text_join": f"SELECT conv_id, coalesce(string_agg(t, ' ' ORDER BY turn, t) FILTER (t <> ''), '') AS joined FROM (SELECT conv_id, turn, {stripped('text')} AS t FROM conversations) GROUP BY conv_id",
        "vad_segments": segments,
        "vad_segments_pieces": segments.replace(STREAMS, ONE_STREAM),
        "vad_stream": segments,
        "vad_stream_flush": segments.replace(CLOSED, CLOSED_OR_LAST),
        "vad_frames_preroll": f"WITH RECURSIVE {FRAMES} SELECT s AS stream_id, CAST(n AS INT) AS segment_no, CAST(row_number() OVER (PARTITION BY s, n ORDER BY seq) - 1 AS INT) AS place, seq FROM held",
    }
