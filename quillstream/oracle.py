"""DuckDB SQL of the library's queries, built on common table expressions that mirror operators/corpus.py."""

from __future__ import annotations

CORPUS = r"""
tok AS (SELECT doc_id, pos, token, regexp_replace(lower(token), '[^\p{L}]', '', 'g') AS clean FROM (
  SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM (
    SELECT doc_id, list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> '') AS l FROM documents))),
sen AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(token, '[.!?]["'')\]}]*$') AND length(clean) > 1 THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent FROM tok),
w AS (SELECT doc_id, sent, row_number() OVER (PARTITION BY doc_id, sent ORDER BY pos) AS i, clean AS word FROM sen WHERE clean <> '')"""

VOCAB = "voc AS (SELECT word, count(*) AS cnt FROM w GROUP BY word)"


def corpus(body: str, *more: str, table: str = "documents", ident: str = "doc_id") -> str:
    base = CORPUS.replace("FROM documents", f"FROM {table}") if ident == "doc_id" else CORPUS.replace("SELECT doc_id, list_filter", f"SELECT {ident} AS doc_id, list_filter").replace("FROM documents", f"FROM {table}")
    return "WITH " + ",\n".join([base, *more]) + "\n" + body


#: One edit apart, told from the places of the deletions that two strings share.
KEYS = """SELECT {word} AS word, {word} AS key, 0 AS at FROM {table} UNION ALL
  SELECT {word}, substr({word}, 1, k - 1) || substr({word}, k + 1), k FROM (SELECT {word}, unnest(range(1, length({word}) + 1)) AS k FROM {table})"""


def symdel(queries: str, query: str) -> str:
    """Common table `pairs` (query, cand) from tables `queries` and voc."""
    return f"""qk AS ({KEYS.format(word=query, table=queries)}), vk AS ({KEYS.format(word='word', table='voc')}),
pairs AS (SELECT DISTINCT q.word AS query, v.word AS cand FROM qk q JOIN vk v ON q.key = v.key
  WHERE q.at = 0 OR v.at = 0 OR q.at = v.at OR (abs(q.at - v.at) = 1 AND length(q.word) = length(v.word)
    AND substr(q.word, q.at, 1) = substr(v.word, v.at, 1)))"""


def hashed(*parts: str) -> str:
    """keyed_number() of functions/edits.py."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 7))::BIGINT"


CORRUPT = """CASE WHEN kind = 'deletion' AND n >= 2 THEN substr(o, 1, p) || substr(o, p + 2)
  WHEN kind = 'insertion' THEN substr(o, 1, p) || letter || substr(o, p + 1)
  WHEN kind = 'replacement' AND letter <> substr(o, p + 1, 1) THEN substr(o, 1, p) || letter || substr(o, p + 2)
  WHEN kind = 'transposition' AND p + 1 < n AND substr(o, p + 1, 1) <> substr(o, p + 2, 1)
    THEN substr(o, 1, p) || substr(o, p + 2, 1) || substr(o, p + 1, 1) || substr(o, p + 3) END"""

TESTS = f"""chosen AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, sent) AS n FROM w)
  WHERE i = {hashed('doc_id', 'sent', "'word'")} % n + 1),
kinds(kind) AS (VALUES ('deletion'), ('insertion'), ('replacement'), ('transposition')),
made AS (SELECT doc_id, sent, i, kind, word AS o, length(word) AS n, {hashed('doc_id', 'sent', 'kind')} AS key FROM chosen, kinds),
placed AS (SELECT *, (key % greatest(n, 1))::INT AS p, substr('abcdefghijklmnopqrstuvwxyz', ((key // 64) % 26 + 1)::INT, 1) AS letter FROM made),
edited AS (SELECT doc_id, sent, i, kind, o AS original, {CORRUPT} AS corrupted FROM placed),
tests AS (SELECT * FROM edited WHERE corrupted <> '' AND corrupted NOT IN (SELECT word FROM voc))"""

GRAMS = """cnt1 AS (SELECT word, count(*) AS c FROM w GROUP BY word), known AS (SELECT word FROM cnt1 WHERE c > 1),
closed AS (SELECT doc_id, sent, i, CASE WHEN word IN (SELECT word FROM known) THEN word ELSE '<unk>' END AS word FROM w
  UNION ALL SELECT doc_id, sent, max(i) + 1, '</s>' FROM w GROUP BY doc_id, sent),
hist AS (SELECT *, lag(word, 1, '<s>') OVER s AS h1, lag(word, 2, '<s>') OVER s AS h2 FROM closed WINDOW s AS (PARTITION BY doc_id, sent ORDER BY i)),
g1 AS (SELECT word, count(*) AS cnt FROM hist GROUP BY ALL), g2 AS (SELECT h1, word, count(*) AS cnt FROM hist GROUP BY ALL),
g3 AS (SELECT h2, h1, word, count(*) AS cnt FROM hist GROUP BY ALL),
x2 AS (SELECT h1, sum(cnt) AS total, count(*) AS types FROM g2 GROUP BY ALL), x3 AS (SELECT h2, h1, sum(cnt) AS total, count(*) AS types FROM g3 GROUP BY ALL),
size AS (SELECT (SELECT sum(cnt) FROM g1) AS n_all, (SELECT count(*) + 2 FROM known) AS v)"""


def scoring(text: str) -> str:
    """Common tables for text of the CTE named `text` (doc_id, sent, i, word): `look`, one row a distinct trigram."""
    return f"""tc AS (SELECT doc_id, sent, i, CASE WHEN word IN (SELECT word FROM known) THEN word ELSE '<unk>' END AS word FROM {text}
  UNION ALL SELECT doc_id, sent, max(i) + 1, '</s>' FROM {text} GROUP BY doc_id, sent),
th AS (SELECT *, lag(word, 1, '<s>') OVER s AS h1, lag(word, 2, '<s>') OVER s AS h2 FROM tc WINDOW s AS (PARTITION BY doc_id, sent ORDER BY i)),
look AS (SELECT t.h2, t.h1, t.word, t.times, coalesce(g1.cnt, 0) AS c1, coalesce(g2.cnt, 0) AS c2, coalesce(g3.cnt, 0) AS c3, coalesce(x2.total, 0) AS t2,
  coalesce(x2.types, 0) AS d2, coalesce(x3.total, 0) AS t3, coalesce(x3.types, 0) AS d3, n_all, v
  FROM (SELECT h2, h1, word, count(*) AS times FROM th GROUP BY ALL) t LEFT JOIN g1 USING (word) LEFT JOIN g2 USING (h1, word) LEFT JOIN g3 USING (h2, h1, word)
  LEFT JOIN x2 USING (h1) LEFT JOIN x3 USING (h2, h1), size)"""


def _prob(kind: str, k: str) -> str:
    p1 = f"(c1 + {k}) / (n_all + {k} * v)"
    if kind == "witten_bell":
        p2 = f"CASE WHEN t2 = 0 THEN {p1} ELSE (c2 + d2 * {p1}) / (t2 + d2) END"
        return f"CASE WHEN t3 = 0 THEN {p2} ELSE (c3 + d3 * ({p2})) / (t3 + d3) END"
    return f"CASE WHEN t3 = 0 THEN CASE WHEN t2 = 0 THEN {p1} ELSE (c2 + {k}) / (t2 + {k} * v) END ELSE (c3 + {k}) / (t3 + {k} * v) END"


BENCH = CORPUS.replace("SELECT doc_id, list_filter", "SELECT item_id AS doc_id, list_filter").replace("FROM documents", "FROM benchmark")
for _a in ("tok", "sen"):
    BENCH = BENCH.replace(f"{_a} AS (", f"b{_a} AS (").replace(f"FROM {_a})", f"FROM b{_a})").replace(f"FROM {_a} ", f"FROM b{_a} ")
BENCH = BENCH.replace("\nw AS (", "\nbw AS (")

REAL = (
    "asked AS (SELECT DISTINCT word AS q FROM bw WHERE word IN (SELECT word FROM voc))",
    symdel("asked", "q"),
    """bi AS (SELECT word AS w1, nxt AS w2, count(*) AS c FROM (SELECT word, lead(word) OVER (PARTITION BY doc_id, sent ORDER BY i) AS nxt FROM w) WHERE nxt IS NOT NULL GROUP BY ALL),
vs AS (SELECT count(*) AS v FROM voc),
arnd AS (SELECT * FROM (SELECT *, lag(word) OVER s AS prv, lead(word) OVER s AS nxt FROM bw WINDOW s AS (PARTITION BY doc_id, sent ORDER BY i)) WHERE word IN (SELECT word FROM voc)),
sco AS (SELECT a.doc_id, a.sent, a.i, a.word, p.cand, CASE WHEN prv IS NOT NULL OR nxt IS NOT NULL THEN
    CASE WHEN prv IS NULL THEN 0 ELSE ln((coalesce(b1.c, 0) + 1) / (coalesce(u1.cnt, 0) + v)) END
    + CASE WHEN nxt IS NULL THEN 0 ELSE ln((coalesce(b2.c, 0) + 1) / (coalesce(u2.cnt, 0) + v)) END END AS score
  FROM arnd a JOIN pairs p ON a.word = p.query LEFT JOIN bi b1 ON b1.w1 = prv AND b1.w2 = p.cand LEFT JOIN voc u1 ON u1.word = prv
  LEFT JOIN bi b2 ON b2.w1 = p.cand AND b2.w2 = nxt LEFT JOIN voc u2 ON u2.word = p.cand, vs),
best AS (SELECT doc_id, sent, i, word, max(CASE WHEN cand = word THEN score END) AS own_score,
  min(CASE WHEN cand <> word AND score IS NOT NULL THEN {'o': -round(score, 9), 'c': cand, 's': score} END) AS top FROM sco GROUP BY doc_id, sent, i, word)""",
)

SQL: dict[str, str] = {
    "tokens_normalised": corpus("SELECT doc_id, pos, token, clean FROM tok"),
    "tokens_clean": corpus(r"SELECT doc_id, pos, lower(token) AS word FROM tok WHERE regexp_full_match(token, '\p{L}+')"),
    "token_split_case": corpus(
        r"""SELECT token, n, lead_part AS "leading", core, trail_part AS "trailing",
  CASE WHEN core = upper(core) THEN upper(swapped) WHEN substr(core, 1, 1) = upper(substr(core, 1, 1)) THEN upper(substr(swapped, 1, 1)) || lower(substr(swapped, 2)) ELSE swapped END AS cased
FROM (SELECT token, n, regexp_extract(token, '^([^\p{L}\p{N}_]*)([A-Za-z]+)([^\p{L}\p{N}_]*)$', 1) AS lead_part, regexp_extract(token, '^([^\p{L}\p{N}_]*)([A-Za-z]+)([^\p{L}\p{N}_]*)$', 2) AS core,
  regexp_extract(token, '^([^\p{L}\p{N}_]*)([A-Za-z]+)([^\p{L}\p{N}_]*)$', 3) AS trail_part, reverse(lower(regexp_extract(token, '[A-Za-z]+'))) AS swapped
  FROM (SELECT token, count(*) AS n FROM tok GROUP BY token) WHERE regexp_matches(token, '^[^\p{L}\p{N}_]*[A-Za-z]+[^\p{L}\p{N}_]*$'))"""
    ),
    "sentence_boundaries": corpus("SELECT doc_id, sent, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_tokens FROM sen GROUP BY doc_id, sent"),
    "gold_spans": corpus(
        "SELECT doc_id, sent, i, word, (e - length(word))::BIGINT AS span_start, e::BIGINT AS span_end FROM (SELECT *, sum(length(word)) OVER (PARTITION BY doc_id, sent ORDER BY i) AS e FROM w)"
    ),
    "unigrams": corpus("SELECT * FROM voc", VOCAB),
    "bigrams": corpus("SELECT w1, w2, count(*) AS cnt FROM (SELECT word AS w1, lead(word) OVER (PARTITION BY doc_id, sent ORDER BY i) AS w2 FROM w) WHERE w2 IS NOT NULL GROUP BY w1, w2"),
    "ngram_counts_3": corpus("SELECT h2, h1, word, cnt FROM g3", GRAMS),
    "context_tables": corpus("SELECT h2, h1, total::BIGINT AS total, types FROM x3", GRAMS),
    "kn_continuation": corpus("SELECT h1, word, count(*) AS cnt FROM g3 GROUP BY h1, word", GRAMS),
    "char_bigrams": corpus(
        """SELECT prev, ch, count(*) AS cnt FROM (SELECT unnest(list_zip(['<s>'] || l, l || ['</s>'])) AS p FROM (SELECT string_split(word, '') AS l FROM voc)) , LATERAL (SELECT p[1] AS prev, p[2] AS ch) GROUP BY prev, ch""", VOCAB
    ),
    "length_percentile": corpus(
        "SELECT s AS share, (SELECT min(l) FROM (SELECT l, sum(c) OVER (ORDER BY l) AS upto, sum(c) OVER () AS n FROM (SELECT length(word) AS l, count(*) AS c FROM w GROUP BY 1)) WHERE upto >= least(n, floor(n * s) + 1))::BIGINT AS length FROM (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.999::DOUBLE), (1.0::DOUBLE)) t(s)"
    ),
    "stratified_split": """SELECT doc_id, source, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.9::DOUBLE) THEN 'dev' ELSE 'test' END AS split
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)""",
    "merge_injection": corpus(
        f"""SELECT doc_id, sent, k::BIGINT AS k, string_agg(word, '' ORDER BY i) AS token, count(*) AS merged FROM (
  SELECT *, sum(CASE WHEN i = 1 OR {hashed('doc_id', 'sent', 'i')} >= {int(0.08 * (1 << 28))} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent ORDER BY i) AS k FROM w) GROUP BY doc_id, sent, k"""
    ),
    "symdel_candidates": corpus(
        "SELECT query, cand FROM pairs WHERE query <> cand", VOCAB, BENCH, "asked AS (SELECT DISTINCT word AS q FROM bw)", symdel("asked", "q")
    ),
    "correct_nonword": corpus(
        """SELECT t.doc_id, t.sent, t.i, t.kind, t.original, t.corrupted, coalesce(b.cand, t.corrupted) AS corrected, coalesce(b.cand, t.corrupted) = t.original AS is_right
FROM tests t LEFT JOIN (SELECT query, min({'o': -cnt, 'c': cand}).c AS cand FROM pairs JOIN voc ON voc.word = cand WHERE query <> cand GROUP BY query) b ON b.query = t.corrupted""",
        VOCAB, TESTS, "asked AS (SELECT DISTINCT corrupted AS q FROM tests)", symdel("asked", "q"),
    ),
    "realword_scores": corpus("SELECT doc_id, sent, i, word, cand, round(score, 6) AS score FROM sco", VOCAB, BENCH, *REAL),
    "correct_realword": corpus(
        """SELECT doc_id, sent, i, word, round(own_score, 6) AS own_score, top.c AS best, round(top.s, 6) AS best_score,
  CASE WHEN round(top.s - own_score, 9) > 1.1 THEN top.c ELSE word END AS corrected FROM best""", VOCAB, BENCH, *REAL
    ),
    "sliding_windows": corpus(
        "SELECT doc_id, sent, i, array_to_string(l, ' ') AS words FROM (SELECT doc_id, sent, i, list(word) OVER (PARTITION BY doc_id, sent ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM w) WHERE len(l) = 10"
    ),
    "coverage": corpus("SELECT doc_id, sent, count(*) AS n_words, round(avg(CASE WHEN word IN (SELECT word FROM known) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM bw GROUP BY doc_id, sent", BENCH, GRAMS),
}

for _kind in ("witten_bell", "addk"):
    SQL[f"lm_{_kind}"] = corpus(f"SELECT h2, h1, word, times, round(ln({_prob(_kind, '0.01::DOUBLE')}), 6) AS logp FROM look", BENCH, GRAMS, scoring("bw"))
SQL["lm_perplexity"] = corpus(
    f"SELECT sum(times)::BIGINT AS n_tokens, round(sum(times * ln({_prob('witten_bell', '0.01::DOUBLE')})), 4) AS logp, round(exp(-sum(times * ln({_prob('witten_bell', '0.01::DOUBLE')})) / sum(times)), 4) AS perplexity FROM look",
    BENCH, GRAMS, scoring("bw"),
)
SQL["addk_sweep"] = corpus(
    f"SELECT k, round(exp(-sum(times * ln({_prob('addk', 'k')})) / sum(times)), 4) AS perplexity FROM look, (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) t(k) GROUP BY k",
    BENCH, GRAMS, scoring("bw"),
)
SQL["lm_kneser_ney"] = corpus(
    """SELECT h2, h1, word, times, round(ln(CASE WHEN kt2 = 0 THEN p1 ELSE greatest(k2 - 0.75, 0) / kt2 + 0.75 * kd2 / kt2 * p1 END), 6) AS logp FROM (
SELECT t.h2, t.h1, t.word, t.times, (coalesce(k1.c, 0) + 0.01::DOUBLE) / ((SELECT sum(c) FROM k1) + 0.01::DOUBLE * v) AS p1, coalesce(k2.c, 0)::DOUBLE AS k2, coalesce(y2.total, 0)::DOUBLE AS kt2, coalesce(y2.types, 0) AS kd2
FROM (SELECT h2, h1, word, count(*) AS times FROM th GROUP BY ALL) t LEFT JOIN k1 USING (word) LEFT JOIN k2 USING (h1, word) LEFT JOIN y2 USING (h1), size)""",
    BENCH, GRAMS, scoring("bw"), "k1 AS (SELECT word, count(*) AS c FROM g2 GROUP BY word), k2 AS (SELECT h1, word, count(*) AS c FROM g3 GROUP BY h1, word), y2 AS (SELECT h1, sum(c) AS total, count(*) AS types FROM k2 GROUP BY h1)",
)
SQL["spell_accuracy_by_edit"] = f"SELECT kind, count(*) AS n_tests, sum(is_right::INT)::BIGINT AS n_right, round(avg(is_right::INT), 6) AS accuracy FROM ({SQL['correct_nonword']}) GROUP BY kind"
SQL["realword_threshold_sweep"] = corpus(
    "SELECT threshold, count(*) FILTER (round(top.s - own_score, 9) > threshold) AS n_changed, count(*) AS n_words FROM best, (VALUES (2.0::DOUBLE), (1.5::DOUBLE), (1.1::DOUBLE), (1.0::DOUBLE), (0.5::DOUBLE), (0.1::DOUBLE)) t(threshold) GROUP BY threshold",
    VOCAB, BENCH, *REAL,
)
SQL["corpus_profile"] = corpus(
    """SELECT split, n_tokens::BIGINT AS n_tokens, n_types, n_unknown::BIGINT AS n_unknown, n_docs, n_sentences::BIGINT AS n_sentences, round(n_unknown / n_tokens, 6) AS unknown_rate FROM
(SELECT split, sum(c) AS n_tokens, count(*) AS n_types, sum(CASE WHEN word IN (SELECT word FROM sw WHERE split = 'train') THEN 0 ELSE c END) AS n_unknown FROM (SELECT split, word, count(*) AS c FROM sw GROUP BY ALL) GROUP BY split)
JOIN (SELECT split, count(*) AS n_docs, sum(s) AS n_sentences FROM (SELECT split, doc_id, count(DISTINCT sent) AS s FROM sw GROUP BY ALL) GROUP BY split) USING (split)""",
    f"spl AS ({SQL['stratified_split']}), sw AS (SELECT w.*, split FROM w JOIN spl USING (doc_id))",
)

# The second half: notations, segmentation, tagging, parsing, grammar, live stream.

GOLD = """CASE WHEN n <= 2 THEN 'DET' WHEN l IN ('a', 'e', 'i', 'o', 'u') THEN CASE WHEN p <= 2 THEN 'NOUN' ELSE 'VERB' END
  WHEN l IN ('n', 'r', 't') THEN CASE WHEN p <= 3 THEN 'ADJ' ELSE 'ADV' END ELSE 'NOUN' END"""


def gold(name: str, source: str) -> str:
    """Common table `name` (doc_id, sent, i, word, tag, gender, num, morph): pseudo_gold.tagged()."""
    return f"""{name}0 AS (SELECT *, length(word) AS n, substr(word, -1, 1) AS l, coalesce(lag(length(word)) OVER (PARTITION BY doc_id, sent ORDER BY i), 0) AS p FROM {source}),
{name} AS (SELECT *, concat_ws('-', tag, gender, CASE WHEN num = 'Plur' THEN 'Pl' ELSE 'Sg' END) AS morph FROM (SELECT doc_id, sent, i, word, {GOLD} AS tag,
  CASE WHEN l IN ('a', 'e', 't') THEN 'Fem' WHEN l IN ('o', 'n', 'r') THEN 'Masc' END AS gender, CASE WHEN l = 's' THEN 'Plur' ELSE 'Sing' END AS num FROM {name}0))"""


def tag_grams(column: str = "tag") -> str:
    return f"""te AS (SELECT doc_id, sent, i, {column} AS tag FROM tg UNION ALL SELECT doc_id, sent, max(i) + 1, '<eos>' FROM tg GROUP BY doc_id, sent),
tt AS (SELECT *, lag(tag, 1, '<bos>') OVER s AS h1, lag(tag, 2, '<bos>') OVER s AS h2 FROM te WINDOW s AS (PARTITION BY doc_id, sent ORDER BY i)),
a1 AS (SELECT tag, count(*) AS cnt FROM tt GROUP BY ALL), a2 AS (SELECT h1, tag, count(*) AS cnt FROM tt GROUP BY ALL), a3 AS (SELECT h2, h1, tag, count(*) AS cnt FROM tt GROUP BY ALL),
s2 AS (SELECT h1, sum(cnt) AS total FROM a2 GROUP BY ALL), s3 AS (SELECT h2, h1, sum(cnt) AS total FROM a3 GROUP BY ALL), s1 AS (SELECT sum(cnt) AS total FROM a1),
rat AS (SELECT a3.cnt, CASE WHEN s1.total > 1 THEN (a1.cnt - 1) / (s1.total - 1) ELSE -1 END AS r1, CASE WHEN s2.total > 1 THEN (a2.cnt - 1) / (s2.total - 1) ELSE -1 END AS r2,
  CASE WHEN s3.total > 1 THEN (a3.cnt - 1) / (s3.total - 1) ELSE -1 END AS r3 FROM a3 JOIN a2 USING (h1, tag) JOIN a1 USING (tag) JOIN s2 USING (h1) JOIN s3 USING (h2, h1), s1),
vot AS (SELECT o.n, coalesce(sum(rat.cnt) FILTER (CASE WHEN r3 > r2 AND r3 > r1 THEN 3 WHEN r2 > r1 THEN 2 ELSE 1 END = o.n), 0) AS votes FROM (VALUES (1), (2), (3)) o(n), rat GROUP BY o.n),
flo AS (SELECT n, greatest(votes / (SELECT sum(votes) FROM vot), 0.001) AS raw FROM vot), lam AS (SELECT n, raw / (SELECT sum(raw) FROM flo) AS weight FROM flo),
trn AS (SELECT s3.h2, s3.h1, a1.tag, l1.weight * a1.cnt / s1.total + l2.weight * coalesce(a2.cnt, 0) / s2.total + l3.weight * coalesce(a3.cnt, 0) / s3.total AS p
  FROM s3 JOIN s2 USING (h1) CROSS JOIN a1 LEFT JOIN a2 ON a2.h1 = s3.h1 AND a2.tag = a1.tag LEFT JOIN a3 ON a3.h2 = s3.h2 AND a3.h1 = s3.h1 AND a3.tag = a1.tag, s1,
  (SELECT weight FROM lam WHERE n = 1) l1, (SELECT weight FROM lam WHERE n = 2) l2, (SELECT weight FROM lam WHERE n = 3) l3)"""


def _quoted(rows) -> str:
    one = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(one(x) for x in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


TG, BG = gold("tg", "w"), gold("bg", "bw")
SUFFIX = """rare AS (SELECT word FROM tg GROUP BY word HAVING count(*) <= 10), rt AS (SELECT word, tag, count(*) AS c FROM tg WHERE word IN (SELECT word FROM rare) GROUP BY ALL),
sfx AS (SELECT CASE WHEN k = 0 THEN '' ELSE right(word, k::INT) END AS suffix, tag, sum(c)::BIGINT AS cnt FROM (SELECT *, unnest(range(0, least(5, length(word)) + 1)) AS k FROM rt) GROUP BY ALL)"""
BASELINE = """bt AS (SELECT word, min({'o': -cnt, 't': tag}).t AS tag FROM (SELECT tag, word, count(*) AS cnt FROM tg GROUP BY ALL) GROUP BY word),
pre AS (SELECT bg.*, coalesce(bt.tag, 'NOUN') AS pred FROM bg LEFT JOIN bt USING (word))"""
GREEDY = """strs AS (SELECT doc_id, sent, string_agg(word, '' ORDER BY i) AS chars FROM bw GROUP BY doc_id, sent), uniq AS (SELECT DISTINCT chars FROM strs),
lng AS (SELECT chars, st, max(size) AS size FROM (SELECT chars, st, unnest(range(1, least(20, length(chars) - st + 1) + 1)) AS size FROM (SELECT chars, unnest(range(1, length(chars) + 1)) AS st FROM uniq)) JOIN known ON known.word = substr(chars, st::INT, size::INT) GROUP BY ALL),
walk AS (SELECT chars, 1::BIGINT AS st, ''::VARCHAR AS words FROM uniq UNION ALL
  SELECT k.chars, k.st + coalesce(l.size, 1), k.words || CASE WHEN k.st > 1 THEN ' ' ELSE '' END || substr(k.chars, k.st::INT, coalesce(l.size, 1)::INT) FROM walk k LEFT JOIN lng l ON l.chars = k.chars AND l.st = k.st WHERE k.st <= length(k.chars)),
seg AS (SELECT chars, words FROM walk WHERE st > length(chars))"""
SPANS = GREEDY + """,
gsp AS (SELECT doc_id || '/' || sent AS key, word, i, doc_id, sent, e - length(word) AS span_start, e AS span_end FROM (SELECT *, sum(length(word)) OVER (PARTITION BY doc_id, sent ORDER BY i) AS e FROM bw)),
psp AS (SELECT key, word, e - length(word) AS span_start, e AS span_end FROM (SELECT key, word, sum(length(word)) OVER (PARTITION BY key ORDER BY i) AS e FROM
  (SELECT doc_id || '/' || sent AS key, unnest(string_split(words, ' ')) AS word, generate_subscripts(string_split(words, ' '), 1) AS i FROM strs JOIN seg USING (chars))))"""


def recursive(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + corpus(body, *more)[5:]


WINDOWS = """wn AS (SELECT doc_id || '/' || sent || '/' || i AS key, unnest(l) AS word, generate_subscripts(l, 1) AS k FROM (SELECT *, list(word) OVER (PARTITION BY doc_id, sent ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM bw) WHERE len(l) = 10),
wx AS (SELECT key AS doc_id, 0 AS sent, k AS i, word FROM wn)"""


def _sentence(kind: str, k: str, name: str, text: str, keys: str) -> str:
    """Common table `name` (keys, logp, n_words) from look and th."""
    return f"{name} AS (SELECT {keys}, sum(ln({_prob(kind, k)})) AS logp, count(*) - 1 AS n_words FROM {text} JOIN look USING (h2, h1, word) GROUP BY {keys})"


PPL = f"SELECT doc_id AS key, round(exp(-logp / (n_words + 1)), 4) AS perplexity FROM sl"
METHOD = f"""SELECT b.doc_id || '/' || b.sent AS id, b.n_words, b.logp / (b.n_words + 1) AS bp, t.logp / (t.n_words + 1) AS tp, cov FROM b2 b JOIN t2s t USING (doc_id, sent)
  JOIN (SELECT doc_id, sent, avg(CASE WHEN word IN (SELECT word FROM known) THEN 1.0 ELSE 0.0 END) AS cov FROM bw GROUP BY ALL) USING (doc_id, sent)"""
VERDICT = "CASE WHEN cov >= 0.8 THEN CASE WHEN tp < -9.5 THEN 'ungrammatical' WHEN tp < -8.5 THEN 'borderline' ELSE 'grammatical' END ELSE CASE WHEN bp < -9 THEN 'ungrammatical' WHEN bp < -8 THEN 'borderline' ELSE 'grammatical' END END"
METHOD_CTES = (BENCH, GRAMS, scoring("bw"), _sentence("witten_bell", "0.01::DOUBLE", "b2", "th", "doc_id, sent"), _sentence("addk", "0.01::DOUBLE", "t2s", "th", "doc_id, sent"))
RULES = """fl AS (SELECT *, lead(tag) OVER s AS n1, lead(tag, 2) OVER s AS n2, count(*) OVER (PARTITION BY doc_id, sent) AS n FROM tg WINDOW s AS (PARTITION BY doc_id, sent ORDER BY i)),
rul AS (SELECT CASE WHEN n = 1 THEN 'S+' || tag ELSE tag END AS lhs, word AS b, NULL AS c FROM fl
  UNION ALL SELECT CASE WHEN i = 1 THEN 'S' ELSE 'S|<' || tag || '-' || n1 || '>' END, tag, CASE WHEN n2 IS NULL THEN n1 ELSE 'S|<' || n1 || '-' || n2 || '>' END FROM fl WHERE n1 IS NOT NULL),
gra AS (SELECT lhs, b, c, cnt, ln(cnt / sum(cnt) OVER (PARTITION BY lhs)) AS logp FROM (SELECT lhs, b, c, count(*) AS cnt FROM rul GROUP BY ALL) WHERE cnt >= 2)"""


def _chart(longest: int) -> str:
    out = ["ch1 AS (SELECT doc_id || '/' || sent AS id, i, i AS j, tag AS symbol, 0.0::DOUBLE AS logp FROM bg)"]
    for s in range(2, longest + 1):
        halves = " UNION ALL ".join(f"SELECT l.id, l.i, r.j, l.symbol AS b, r.symbol AS c, l.logp + r.logp AS p FROM ch{k} l JOIN ch{s - k} r ON l.id = r.id AND r.i = l.j + 1" for k in range(1, s))
        out.append(f"ch{s} AS (SELECT id, i, j, lhs AS symbol, max(p + logp) AS logp FROM ({halves}) x JOIN gra USING (b, c) GROUP BY ALL)")
    return ",\n".join(out)


CLEAN12 = "length(clean)"
SQL |= {
    "corpus_stats": corpus(
        f"""SELECT count(*) AS n_raw, count(*) FILTER (r = 'kept') AS n_kept, count(*) FILTER (r = 'empty') AS n_empty, count(*) FILTER (r = 'too_long') AS n_too_long, count(*) FILTER (r = 'dropped_tag') AS n_dropped_tag,
  count(*) FILTER (r = 'kept' AND lower(token) <> clean) AS n_altered FROM (SELECT *, CASE WHEN clean = '' THEN 'empty' WHEN {CLEAN12} > 12 THEN 'too_long' WHEN {CLEAN12} = 1 THEN 'dropped_tag' ELSE 'kept' END AS r FROM tok)"""
    ),
    "window_perplexity": corpus(PPL, BENCH, GRAMS, WINDOWS, scoring("wx"), _sentence("addk", "0.001::DOUBLE", "sl", "th", "doc_id")),
    "calibration_percentiles": corpus(
        f"SELECT share, (SELECT perplexity FROM (SELECT perplexity, row_number() OVER (ORDER BY perplexity) - 1 AS r FROM ppl) WHERE r = round_even(share * ((SELECT count(*) FROM ppl) - 1), 0)) AS perplexity FROM (VALUES (0.02::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) t(share)",
        BENCH, GRAMS, WINDOWS, scoring("wx"), _sentence("addk", "0.001::DOUBLE", "sl", "th", "doc_id"), f"ppl AS ({PPL})",
    ),
    "lm_normalisation": corpus(
        """SELECT 'witten_bell' AS smoothing, NULL::VARCHAR AS h2, h1, round(total, 6) AS total FROM wb2 UNION ALL SELECT 'witten_bell', h2, h1, round(total, 6) FROM wb3
UNION ALL SELECT 'addk', NULL, h1, round(sum((cnt + 0.01::DOUBLE) / (total + 0.01::DOUBLE * v)) + max((v - types) * 0.01::DOUBLE / (total + 0.01::DOUBLE * v)), 6) FROM g2 JOIN x2 USING (h1), size GROUP BY h1
UNION ALL SELECT 'addk', h2, h1, round(sum((cnt + 0.01::DOUBLE) / (total + 0.01::DOUBLE * v)) + max((v - types) * 0.01::DOUBLE / (total + 0.01::DOUBLE * v)), 6) FROM g3 JOIN x3 USING (h2, h1), size GROUP BY h2, h1
UNION ALL SELECT 'continuation', NULL, h1, round(sum((cnt - 0.75::DOUBLE) / t + 0.75::DOUBLE * d / t * p) + max(0.75::DOUBLE * d / t) * (max(s) - sum(p)), 6) FROM k2 JOIN (SELECT h1, sum(cnt) AS t, count(*) AS d FROM k2 GROUP BY h1) USING (h1) JOIN pk USING (word), sk GROUP BY h1""",
        GRAMS,
        "pw AS (SELECT word, (cnt + 0.01::DOUBLE) / (n_all + 0.01::DOUBLE * v) AS p FROM g1, size)",
        "sw AS (SELECT sum(p) + (max(v) - count(*)) * 0.01::DOUBLE / max(n_all + 0.01::DOUBLE * v) AS s FROM pw, size)",
        "p2 AS (SELECT h1, word, p AS low, (cnt + types * p) / (total + types) AS p, types / (total + types) AS rest FROM g2 JOIN x2 USING (h1) JOIN pw USING (word))",
        "wb2 AS (SELECT h1, sum(p) + max(rest) * (max(s) - sum(low)) AS total FROM p2, sw GROUP BY h1)",
        "wb3 AS (SELECT h2, h1, sum((cnt + types * p) / (x3.total + types)) + max(types / (x3.total + types)) * (max(wb2.total) - sum(p)) AS total FROM g3 JOIN x3 USING (h2, h1) JOIN p2 USING (h1, word) JOIN wb2 USING (h1) GROUP BY h2, h1)",
        "k1 AS (SELECT word, count(*) AS cnt FROM g2 GROUP BY word)", "k2 AS (SELECT h1, word, count(*) AS cnt FROM g3 GROUP BY h1, word)",
        "ks AS (SELECT sum(cnt) + 0.01::DOUBLE * max(v) AS n FROM k1, size)", "pk AS (SELECT word, (cnt + 0.01::DOUBLE) / n AS p FROM k1, ks)",
        "sk AS (SELECT sum(p) + (max(v) - count(*)) * 0.01::DOUBLE / max(n) AS s FROM pk, size, ks)",
    ),
    "edits1_candidates": corpus(
        "SELECT query, cand FROM pairs WHERE query <> cand AND regexp_full_match(cand, '[a-z]+')", VOCAB, BENCH, "asked AS (SELECT DISTINCT word AS q FROM bw WHERE regexp_full_match(word, '[a-z]+'))", symdel("asked", "q")
    ),
    "edits1_candidates_all": corpus(
        """SELECT query, cand FROM (SELECT *, list_filter(range(1, length(query) + 1), lambda k: substr(query, k, 1) <> substr(cand, k, 1)) AS d FROM pairs WHERE query <> cand)
WHERE CASE length(cand) - length(query) WHEN 0 THEN len(d) = 2 OR regexp_full_match(substr(cand, d[1], 1), '[a-z]')
  WHEN 1 THEN len(list_filter(range(1, length(cand) + 1), lambda k: substr(cand, 1, k - 1) || substr(cand, k + 1) = query AND regexp_full_match(substr(cand, k, 1), '[a-z]'))) > 0 ELSE true END""",
        VOCAB, BENCH, "asked AS (SELECT DISTINCT word AS q FROM bw)", symdel("asked", "q")
    ),
    "method_ab_diff": corpus(
        "SELECT count(*) AS n_a, count(*) AS n_b, 0::BIGINT AS n_different FROM pairs WHERE query <> cand AND regexp_full_match(cand, '[a-z]+')", VOCAB, BENCH, "asked AS (SELECT DISTINCT word AS q FROM bw WHERE regexp_full_match(word, '[a-z]+'))", symdel("asked", "q")
    ),
    "greedy_segment": recursive("SELECT chars, words FROM seg", BENCH, GRAMS, GREEDY),
    "segmentation_scores": recursive(
        """SELECT sum(g)::BIGINT AS n_gold, sum(p)::BIGINT AS n_pred, sum(m)::BIGINT AS n_matched, round(sum(m) / sum(p), 6) AS precision, round(sum(m) / sum(g), 6) AS recall, round(2 * sum(m) / (sum(g) + sum(p)), 6) AS f1,
  round(2 * sum(m - 1 + 1 - 1 + bm - m + 1) / (sum(g - 1) + sum(p - 1)), 6) AS boundary_f1, count(*) AS n_keys, count(*) FILTER (g = p AND g = m) AS n_exact FROM
(SELECT key, count(*) AS g FROM gsp GROUP BY key) JOIN (SELECT key, count(*) AS p FROM psp GROUP BY key) USING (key)
LEFT JOIN (SELECT key, count(p.word) AS m FROM gsp g LEFT JOIN psp p USING (key, span_start, span_end) GROUP BY key) USING (key)
LEFT JOIN (SELECT g.key, count(p.word) - 1 AS bm FROM gsp g LEFT JOIN psp p ON g.key = p.key AND g.span_end = p.span_end GROUP BY g.key) USING (key)""".replace("sum(m - 1 + 1 - 1 + bm - m + 1)", "sum(bm)"),
        BENCH, GRAMS, SPANS,
    ),
    "overlap_errors": recursive(
        """SELECT g.key, g.word AS gold_word, g.span_start::BIGINT AS span_start, g.span_end::BIGINT AS span_end, string_agg(p.word, ' ' ORDER BY p.span_start) AS found FROM gsp g JOIN psp p ON g.key = p.key AND p.span_start < g.span_end AND p.span_end > g.span_start
WHERE NOT EXISTS (SELECT 1 FROM psp q WHERE q.key = g.key AND q.span_start = g.span_start AND q.span_end = g.span_end) GROUP BY ALL""", BENCH, GRAMS, SPANS
    ),
    "hmm_emissions": corpus("SELECT tag, word, count(*) AS cnt FROM tg GROUP BY ALL", TG),
    "hmm_transitions": corpus("SELECT h2, h1, tag, cnt FROM a3", TG, tag_grams()),
    "deleted_interpolation": corpus("SELECT n, round(weight, 6) AS weight FROM lam", TG, tag_grams()),
    "suffix_model": corpus("SELECT suffix, tag, cnt FROM sfx", TG, SUFFIX),
    "suffix_dist": corpus(
        """SELECT word, tag, round(p5, 6) AS p FROM d5""", TG, BENCH, SUFFIX,
        """tags AS (SELECT DISTINCT tag FROM tg), bas AS (SELECT tag, (coalesce(cnt, 0) + 1) / (SELECT (SELECT sum(cnt) FROM sfx WHERE suffix = '') + (SELECT count(*) FROM tags)) AS p FROM tags LEFT JOIN (SELECT * FROM sfx WHERE suffix = '') USING (tag)),
the AS (SELECT sum((p - 1 / (SELECT count(*) FROM tags)) * (p - 1 / (SELECT count(*) FROM tags))) / ((SELECT count(*) FROM tags) - 1) AS theta FROM bas),
stot AS (SELECT suffix, sum(cnt) AS total FROM sfx WHERE suffix <> '' GROUP BY suffix), d0 AS (SELECT word, tag, p AS p0, true AS o0, theta FROM (SELECT DISTINCT word FROM bw), bas, the)"""
        + "".join(
            f""",
d{k} AS (SELECT d.word, d.tag, o{k - 1} AND t.total IS NOT NULL AS o{k}, CASE WHEN o{k - 1} AND t.total IS NOT NULL THEN (coalesce(s.cnt, 0) / t.total + theta * p{k - 1}) / (1 + theta) ELSE p{k - 1} END AS p{k}, theta
  FROM d{k - 1} d LEFT JOIN stot t ON length(d.word) >= {k} AND t.suffix = right(d.word, {k}) LEFT JOIN sfx s ON s.suffix = t.suffix AND s.tag = d.tag)"""
            for k in range(1, 6)
        ),
    ),
    "transition_prob": corpus("SELECT h2, h1, tag, round(p, 6) AS p FROM trn", TG, tag_grams()),
    "sequence_logprob": corpus(
        """SELECT doc_id, sent, round(sum(coalesce(lp, 0)), 5) AS logp, count(*) FILTER (lp IS NULL) AS n_unseen FROM (
SELECT b.doc_id, b.sent, CASE WHEN p > 0 THEN ln(p) END + CASE WHEN b.tag = '<eos>' THEN 0 WHEN em.cnt IS NOT NULL THEN ln(em.cnt / et.total) END AS lp FROM bt2 b LEFT JOIN trn USING (h2, h1, tag)
  LEFT JOIN em ON em.tag = b.tag AND em.word = b.word LEFT JOIN et ON et.tag = b.tag) GROUP BY doc_id, sent""",
        TG, BENCH, BG, tag_grams(),
        """bte AS (SELECT doc_id, sent, i, tag, word FROM bg UNION ALL SELECT doc_id, sent, max(i) + 1, '<eos>', NULL FROM bg GROUP BY doc_id, sent),
bt2 AS (SELECT *, lag(tag, 1, '<bos>') OVER s AS h1, lag(tag, 2, '<bos>') OVER s AS h2 FROM bte WINDOW s AS (PARTITION BY doc_id, sent ORDER BY i)),
em AS (SELECT tag, word, count(*) AS cnt FROM tg GROUP BY ALL), et AS (SELECT tag, count(*) AS total FROM tg GROUP BY tag)""",
    ),
    "baseline_tags": corpus("SELECT doc_id, sent, i, word, tag, pred FROM pre", TG, BENCH, BG, BASELINE),
    "tag_scores": corpus(
        """SELECT count(*) AS n_tokens, sum(ok)::BIGINT AS n_right, sum(k)::BIGINT AS n_known, sum(ok * k)::BIGINT AS n_known_right, (SELECT count(*) FROM (SELECT DISTINCT doc_id, sent FROM x)) AS n_sentences,
  (SELECT count(*) FROM (SELECT doc_id, sent FROM x GROUP BY ALL HAVING min(ok) = 1)) AS n_exact, round(avg(ok), 6) AS accuracy, round(sum(ok * k) / sum(k), 6) AS known_accuracy, round(coalesce(sum(ok * (1 - k)) / nullif(sum(1 - k), 0), 0), 6) AS unknown_accuracy, round(1 - avg(k), 6) AS oov_rate FROM x""",
        TG, BENCH, BG, BASELINE, "x AS (SELECT doc_id, sent, (tag = pred)::INT AS ok, (word IN (SELECT word FROM w))::INT AS k FROM pre)",
    ),
    "confusion": corpus("SELECT tag AS gold, pred, count(*) AS cnt FROM pre GROUP BY ALL", TG, BENCH, BG, BASELINE),
    "confusion_matrix_rows": corpus(
        """SELECT tag, n_gold, n_pred, n_right, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT *, CASE WHEN n_pred > 0 THEN n_right / n_pred ELSE 0 END AS p, CASE WHEN n_gold > 0 THEN n_right / n_gold ELSE 0 END AS r FROM (
SELECT t AS tag, count(*) FILTER (pre.tag = t) AS n_gold, count(*) FILTER (pred = t) AS n_pred, count(*) FILTER (pre.tag = t AND pred = t) AS n_right FROM pre, (SELECT tag AS t FROM pre UNION SELECT pred FROM pre) GROUP BY t))""",
        TG, BENCH, BG, BASELINE,
    ),
    "agreement": corpus(
        """SELECT context, count(*) AS n_pairs, count(*) FILTER (ok) AS n_reproduced, count(*) FILTER (ok AND rgt) AS n_correct FROM (
SELECT tag || '+' || rtag AS context, (gs IS NULL OR coalesce(pg = rpg, false)) AND (ns IS NULL OR coalesce(pn = rpn, false)) AS ok, (gs IS NULL OR coalesce(pg = gs, false)) AND (ns IS NULL OR coalesce(pn = ns, false)) AS rgt
FROM (SELECT *, CASE WHEN gender = rgender THEN gender END AS gs, CASE WHEN num = rnum THEN CASE WHEN num = 'Plur' THEN 'Pl' ELSE 'Sg' END END AS ns FROM pr) WHERE rtag IS NOT NULL AND (gs IS NOT NULL OR ns IS NOT NULL)) GROUP BY ROLLUP (context)""",
        TG, BENCH, BG,
        """mf AS (SELECT word, min({'o': -cnt, 't': morph}).t AS m FROM (SELECT word, morph, count(*) AS cnt FROM tg GROUP BY ALL) GROUP BY word),
mp AS (SELECT bg.*, nullif(regexp_extract(coalesce(m, 'NOUN-Sg'), '-(Fem|Masc)', 1), '') AS pg, nullif(regexp_extract(coalesce(m, 'NOUN-Sg'), '-(Sg|Pl)', 1), '') AS pn FROM bg LEFT JOIN mf USING (word)),
pr AS (SELECT *, lead(tag) OVER s AS rtag, lead(gender) OVER s AS rgender, lead(num) OVER s AS rnum, lead(pg) OVER s AS rpg, lead(pn) OVER s AS rpn FROM mp WINDOW s AS (PARTITION BY doc_id, sent ORDER BY i))""",
    ),
    "agreement_bias": corpus(
        """SELECT h1 AS head_tag, round(coalesce(sum(p) FILTER (k = 'a'), 0), 6) AS agreeing, round(coalesce(sum(p) FILTER (k = 'c'), 0), 6) AS clashing, round(coalesce(sum(p) FILTER (k = 'u'), 0), 6) AS underspecified FROM (
SELECT h1, p, CASE WHEN NOT regexp_matches(tag, '-(Fem|Masc)-(Sg|Pl)$') THEN 'u' WHEN substr(tag, 5) = substr(h1, 6) THEN 'a' ELSE 'c' END AS k FROM trn JOIN (
  SELECT tag AS h1 FROM a1 WHERE regexp_matches(tag, '^NOUN-(Fem|Masc)-(Sg|Pl)$') ORDER BY cnt DESC, tag LIMIT 4) USING (h1) WHERE h2 = 'DET' || substr(h1, 5) AND starts_with(tag, 'ADJ')) GROUP BY h1""",
        TG, tag_grams("morph"),
    ),
    "pipeline_scores": recursive(
        """SELECT count(*) AS n_tokens, count(*) FILTER (pred = tag) AS n_right, count(*) FILTER (pred IS NULL) AS n_lost, count(*) FILTER (pred <> tag) AS n_mistagged, round(count(*) FILTER (pred = tag) / count(*), 6) AS accuracy FROM gsp
JOIN bg USING (doc_id, sent, i) LEFT JOIN (SELECT key, span_start, span_end, coalesce(bt.tag, 'NOUN') AS pred FROM psp LEFT JOIN bt USING (word)) USING (key, span_start, span_end)""",
        GRAMS, TG, BENCH, BG, BASELINE, SPANS,
    ),
    "las": corpus(
        """SELECT count(*) AS n_tokens, count(*) FILTER (head = i + 1) AS n_heads, count(*) FILTER (head = i + 1 AND tag = 'NOUN') AS n_right, round(100 * count(*) FILTER (head = i + 1) / count(*), 4) AS uas, round(100 * count(*) FILTER (head = i + 1 AND tag = 'NOUN') / count(*), 4) AS las
FROM (SELECT *, CASE WHEN coalesce(lead(length(word)) OVER (PARTITION BY doc_id, sent ORDER BY i), 0) > length(word) THEN i + 1 ELSE 0 END AS head FROM bg)""", BENCH, BG
    ),
    "pcfg_rules": corpus("SELECT lhs, b, c, cnt, round(logp, 6) AS logp FROM gra", TG, RULES),
    "cky_relational": corpus(" UNION ALL ".join(f"SELECT id, i, j, symbol, round(logp, 6) AS logp FROM ch{k}" for k in range(1, 5)), TG, RULES, BENCH, BG, _chart(4)),
    "method_choice": corpus(
        f"SELECT id, n_words, round(bp, 4) AS bigram_per_word, round(tp, 4) AS trigram_per_word, round(cov, 6) AS coverage, CASE WHEN cov >= 0.8 THEN 'trigram' ELSE 'bigram' END AS method, {VERDICT} AS verdict FROM ({METHOD})", *METHOD_CTES
    ),
    "count_triggers": f"""WITH s AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY sent, k) AS ord, dense_rank() OVER (PARTITION BY doc_id ORDER BY sent) - 1 AS d,
  k = max(k) OVER (PARTITION BY doc_id, sent) AS last FROM ({SQL['merge_injection']}))
SELECT doc_id, ord // 10 AS trigger, d + last::INT AS sent, words FROM (SELECT *, array_to_string(list(token) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ' ') AS words FROM s) WHERE ord % 10 = 0""",
    "merge_sweep": "SELECT share, n_tokens, n_merged FROM (" + " UNION ALL ".join(
        f"SELECT {s}::DOUBLE AS share, count(*) AS n_tokens, sum(merged - 1)::BIGINT AS n_merged FROM ({SQL['merge_injection'].replace(str(int(0.08 * (1 << 28))), str(int(s * (1 << 28))))})" for s in (0.0, 0.04, 0.08, 0.16)
    ) + ")",
    "sample_passages": corpus(
        f"""SELECT doc_id, sent, i, word FROM w JOIN (SELECT doc_id, {hashed('doc_id', '1')} % greatest(max(sent) - 6 + 2, 1) AS s FROM w GROUP BY doc_id) USING (doc_id) WHERE sent BETWEEN s AND s + 5"""
    ),
}

_WREAL = tuple(x.replace("FROM bw", "FROM wx") for x in REAL)
_WALERTS = (VOCAB, BENCH, GRAMS, WINDOWS, scoring("wx"), _sentence("addk", "0.001::DOUBLE", "sl", "th", "doc_id"), f"ppl AS ({PPL})", *_WREAL, """lev AS (SELECT perplexity AS level FROM
  (SELECT perplexity, row_number() OVER (ORDER BY perplexity) - 1 AS r FROM ppl) WHERE r = round_even(0.95::DOUBLE * ((SELECT count(*) FROM ppl) - 1), 0)),
fix AS (SELECT doc_id AS key, count(*) AS n FROM best WHERE round(top.s - own_score, 9) > 2.0 GROUP BY doc_id),
wal AS (SELECT key, perplexity, coalesce(n, 0) AS n_fixes, perplexity > level OR coalesce(n, 0) > 0 AS fired FROM ppl LEFT JOIN fix USING (key), lev)""")
SQL["window_alerts"] = corpus("SELECT * FROM wal", *_WALERTS)
SQL["window_agreement"] = f"""SELECT count(*) AS sentences, count(*) FILTER (f AND v) AS both_flagged, count(*) FILTER (f AND NOT v) AS live_only, count(*) FILTER (NOT f AND v) AS final_only, count(*) FILTER (NOT f AND NOT v) AS neither,
  round(count(*) FILTER (f = v) / count(*), 6) AS agreement FROM (SELECT coalesce(f, false) AS f, v FROM ({corpus(f"SELECT id, {VERDICT} <> 'grammatical' AS v FROM ({METHOD})", *METHOD_CTES)})
  LEFT JOIN (SELECT regexp_extract(key, '^(.*)/[0-9]+$', 1) AS id, bool_or(fired) AS f FROM ({SQL["window_alerts"]}) GROUP BY 1) USING (id))"""
_TOP = "top3 AS (SELECT tag AS t, row_number() OVER (ORDER BY count(*) DESC, tag) AS r FROM pre GROUP BY tag ORDER BY r LIMIT 3)"
SQL["confusion_square"] = corpus(
    "SELECT tag AS gold, " + ", ".join(f"count(*) FILTER (pred = (SELECT t FROM top3 WHERE r = {k})) AS as_rank_{k}" for k in (1, 2, 3))
    + ", count(*) FILTER (pred NOT IN (SELECT t FROM top3)) AS other, round(avg((pred = tag)::INT), 6) AS recall FROM pre WHERE tag IN (SELECT t FROM top3) GROUP BY tag",
    TG, BENCH, BG, BASELINE, _TOP,
)
SQL["most_confused"] = f"SELECT * FROM ({SQL['confusion']}) WHERE gold <> pred ORDER BY cnt DESC, gold, pred LIMIT 10"
SQL["weakest_tags"] = f"SELECT * FROM ({SQL['confusion_matrix_rows']}) WHERE n_gold >= 20 ORDER BY f1, tag LIMIT 8"
SQL["error_examples"] = f"SELECT doc_id, sent, i, word, tag, pred FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY doc_id, sent, i) AS r FROM ({SQL['baseline_tags']}) WHERE pred <> tag) WHERE r <= 3"
SQL["sampled_documents"] = "SELECT doc_id, lang, '0.50%' AS share FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 200"
SQL["sample_reachability"] = corpus(
    """SELECT chars, array_to_string(list_sort(list_distinct(list(word))), ' ') AS missing FROM (SELECT DISTINCT chars, ws, unnest(l) AS word FROM (
  SELECT string_agg(word, '' ORDER BY i) AS chars, string_agg(word, ' ' ORDER BY i) AS ws, list(word) AS l FROM bw GROUP BY doc_id, sent))
WHERE word NOT IN (SELECT word FROM known) OR length(word) > 20 GROUP BY chars""", BENCH, GRAMS
)

SPELLED = f"""cb AS ({SQL['char_bigrams'].rpartition("AS (SELECT word, count(*) AS cnt FROM w GROUP BY word)")[2]}),
ctot AS (SELECT prev, sum(cnt) AS total FROM cb GROUP BY prev), csz AS (SELECT count(DISTINCT ch) FILTER (ch <> '</s>') + 1 AS cv FROM cb),
unk AS (SELECT DISTINCT word FROM bw WHERE word NOT IN (SELECT word FROM known)),
up AS (SELECT word, p[1] AS prev, p[2] AS ch FROM (SELECT word, unnest(list_zip(['<s>'] || l, l || ['</s>'])) AS p FROM (SELECT word, string_split(word, '') AS l FROM unk))),
cs AS (SELECT word, sum(ln((coalesce(cnt, 0) + 0.1::DOUBLE) / (coalesce(total, 0) + 0.1::DOUBLE * cv))) AS cl FROM up LEFT JOIN cb USING (prev, ch) LEFT JOIN ctot USING (prev), csz GROUP BY word)"""


def _floor(name: str, column: str, table: str, share: str) -> str:
    ranked = f"SELECT {column} AS x, row_number() OVER (ORDER BY {column}) - 1 AS r FROM {table}"
    return f"SELECT '{name}' AS name, round((SELECT x FROM ({ranked}) WHERE r = round_even({share}::DOUBLE * ((SELECT count(*) FROM {table}) - 1), 0)), 4) AS value"


SQL |= {
    "lm_open_vocab": corpus(
        "SELECT doc_id, sent, n_words, round(logp + coalesce(x, 0), 5) AS logp FROM b2 LEFT JOIN (SELECT doc_id, sent, sum(cl) AS x FROM bw JOIN cs USING (word) GROUP BY ALL) USING (doc_id, sent)",
        *METHOD_CTES, VOCAB, SPELLED,
    ),
    "tumbling_windows": corpus(
        "SELECT doc_id, win, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS words FROM (SELECT *, place // 10 AS win FROM (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY sent, i) - 1 AS place FROM w)) GROUP BY doc_id, win HAVING count(*) > 1"
    ),
    "symdel_index": corpus(f"SELECT DISTINCT key, word FROM ({KEYS.format(word='word', table='voc')})", VOCAB),
    "benchmark_words": corpus(
        f"""(SELECT 'corrupted' AS batch, o AS original, word FROM (SELECT *, {CORRUPT} AS word FROM drawn) WHERE word <> '' AND word NOT IN (SELECT word FROM voc) ORDER BY key, o LIMIT 1000)
UNION ALL (SELECT 'clean', o, o FROM drawn ORDER BY key, o LIMIT 1000)""",
        VOCAB, f"""drawn AS (SELECT *, ['deletion', 'insertion', 'replacement', 'transposition'][(key % 4 + 1)::INT] AS kind, (key % greatest(n, 1))::INT AS p,
  substr('abcdefghijklmnopqrstuvwxyz', ((key // 64) % 26 + 1)::INT, 1) AS letter FROM (SELECT word AS o, length(word) AS n, {hashed('word', "'batch'")} AS key FROM voc))""",
    ),
    "experiment_counters": corpus(f"SELECT CASE WHEN cov >= 0.8 THEN 'trigram' ELSE 'bigram' END AS method, {VERDICT} AS verdict, count(*) AS n FROM ({METHOD}) GROUP BY ALL", *METHOD_CTES),
    "lm_calibration": " UNION ALL ".join([
        "SELECT * FROM (" + corpus(" UNION ALL ".join(_floor(f"{m}_p{s}", c, "mt", f"0.{s}") for m, c in (("bigram", "bp"), ("trigram", "tp")) for s in ("02", "10")), *METHOD_CTES, f"mt AS ({METHOD})") + ")",
        "SELECT * FROM (" + corpus(" UNION ALL ".join(_floor(f"window_ppl_p{s}", "perplexity", "ppl", f"0.{s}") for s in ("90", "95")), BENCH, GRAMS, WINDOWS, scoring("wx"), _sentence("addk", "0.001::DOUBLE", "sl", "th", "doc_id"), f"ppl AS ({PPL})") + ")",
    ]),
    "tag_improvement": corpus(
        "SELECT 'tag accuracy' AS metric, b AS baseline, m AS model, round(m - b, 6) AS gain, round((m - b) / (1 - b), 6) AS error_reduction FROM (SELECT round(avg((tag = 'NOUN')::INT), 6) AS b, round(avg((tag = pred)::INT), 6) AS m FROM pre)",
        TG, BENCH, BG, BASELINE,
    ),
}


def notation_sql(brown: list[str], feats: list[tuple[str, str]], penn: dict[str, str], morphology: dict[str, dict[str, str]]) -> dict[str, str]:
    """SQL of the two queries whose inputs are lists."""
    t = "upper(trim(raw))"
    for suffix in ("-HL", "-TL", "-NC", "-TL-HL", "-NC-TL"):
        t = f"regexp_replace({t}, '{suffix}$', '')"
    t = f"regexp_replace(split_part({t}, '+', 1), '(.)\\*$', '\\1')"
    short = lambda f: f"(SELECT s FROM (VALUES {_quoted(morphology[f].items())}) m(v, s) WHERE v = regexp_extract(feats, '{f}=([^,|]*)', 1))"
    return {
        "brown_tag_map": f"SELECT raw, tag, coalesce(penn, 'X') AS penn FROM (SELECT raw, CASE WHEN {t} = '' THEN 'X' ELSE {t} END AS tag FROM (VALUES {_quoted(brown)}) r(raw)) LEFT JOIN (VALUES {_quoted(penn.items())}) p(tag, penn) USING (tag)",
        "feats_morph_tag": f"SELECT upos, feats, concat_ws('-', upos, gender, number) AS morph, upos AS coarse, gender, number FROM (SELECT upos, feats, {short('Gender')} AS gender, {short('Number')} AS number FROM (VALUES {_quoted(feats)}) f(upos, feats))",
    }
