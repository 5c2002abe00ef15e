"""The registered queries once more, as SQL over the same tables.

Written against DuckDB, whose regular expressions know no lookaround: a left
context is a captured character there, and a pass is repeated because adjacent
matches share that character.
"""

from __future__ import annotations

from html.entities import html5

from textassay.functions.patterns import NAMES_ALT
from textassay.functions.text import WHITESPACE
from textassay.operators.collision import SUSPECTS
from textassay.operators.neardup import SWEEP
from textassay.operators.sampling import LADDER
from textassay.plans.experiment import SOURCE_MARKERS
from textassay.plans.inputs import LANGUAGES, NAMED_ESCAPES, NUMERIC_ESCAPES

WORDS = r"[\p{L}\p{N}_]"
NUM = r"#\p{Nd}{2,4};"
REPAIRABLE = r"#(?:3[0-9]|1[0-9]{2}|2[0-9]{2});"
NAMED = f"(?:{NAMES_ALT});"
LOW, PERCENT, TAU = 2, 10, 0.8
MARKERS = SOURCE_MARKERS + "|(?i)licen[cs]e|copyright"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def bare_num(t: str) -> str:
    return f"regexp_matches({t}, '{NUM}')"


def bare_named(t: str) -> str:
    return rf"regexp_matches({t}, '(?:^|[^\p{{L}}\p{{N}}_]){NAMED}')"


def intact(t: str) -> str:
    return rf"regexp_matches({t}, '&(?:#\p{{Nd}}+|{WORDS}+);')"


def corrupt(t: str) -> str:
    return f"({bare_num(t)} OR {bare_named(t)})"


def loose(t: str) -> str:
    return f"({bare_num(t)} OR regexp_matches({t}, '{NAMED}'))"


def markup(t: str) -> str:
    return rf"regexp_matches({t}, '&lt;\s*/?[A-Za-z]')"


PREDICATES = {"bare_num": bare_num, "bare_named": bare_named, "intact": intact, "any_bare": corrupt,
              "markup": markup, "loose": loose}


def dirty(t: str) -> str:
    for char, name in NAMED_ESCAPES:
        t = f"replace({t}, {quote(char)}, ' {name};')"
    for char in NUMERIC_ESCAPES:
        t = f"replace({t}, {quote(char)}, ' #{ord(char)};')"
    return t


def restored(t: str) -> str:
    t = f"regexp_replace({t}, ' ({REPAIRABLE})', '&\\1', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '(^|[^&])({REPAIRABLE})', '\\1&\\2', 'g')"
    t = f"regexp_replace({t}, ' ({NAMED})', '&\\1', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '(^|[^&\p{{L}}\p{{N}}_])({NAMED})', '\1&\2', 'g')"
    return t


def unescaped(t: str) -> str:
    """Only the entities the tables hold; the ampersand's own goes last."""
    for char in NUMERIC_ESCAPES + "·":
        if 30 <= ord(char) <= 39 or 100 <= ord(char) <= 299:
            t = f"replace({t}, '&#{ord(char)};', {quote(char)})"
    for name in ("copy", "middot", "quot", "lt", "gt", "amp"):
        t = f"replace({t}, '&{name};', {quote(html5[name + ';'])})"
    return t


def tokens(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '{WORDS}{{2,}}')"


LABEL = "CASE lang " + " ".join(f"WHEN '{lang}' THEN {value}" for value, lang in LANGUAGES.items()) + " END"
STRIP = "trim({}, " + quote(WHITESPACE) + ")"

CORPUS = f"""corpus AS (
  SELECT *, {STRIP.format('title')} || ' ' || {STRIP.format('description')} AS text FROM (
    SELECT doc_id, {LABEL} AS label, lang AS class_name, source, split_part(text, chr(10), 1) AS title,
           substr(text, length(split_part(text, chr(10), 1)) + 2) AS description FROM documents))"""
DIRTY = f"""{CORPUS}, dirty0 AS (SELECT doc_id, label, class_name, text AS original, {dirty('text')} AS text FROM corpus),
dirty1 AS (SELECT *, {restored('text')} AS half FROM dirty0),
dirty AS (SELECT doc_id, label, class_name, original, text, {unescaped('half')} AS repaired FROM dirty1)"""
GLUED = f"{CORPUS}, glued AS (SELECT doc_id, class_name, regexp_replace(text, '&+', 'amp;', 'g') AS text FROM corpus)"
PAGE_CLASS = """regexp_extract(html, 'lang="(..)"', 1)"""
PAGES = f"""pages1 AS (SELECT page_id, {PAGE_CLASS} AS class_name, url,
    regexp_replace(html, '&(amp|quot);', ' \\1;', 'g') AS half FROM pages),
pages2 AS (SELECT page_id, class_name,
    CASE WHEN starts_with(url, 'http:') THEN replace(half, '&middot;', ' #183;') ELSE half END AS text FROM pages1)"""
ESCAPED_PAGES = f"""pages3 AS (SELECT page_id, {PAGE_CLASS} AS class_name,
    CASE WHEN starts_with(url, 'http:') THEN replace(replace(html, '<', '&lt;'), '>', '&gt;')
         ELSE regexp_replace(html, '<[^>]*>', ' ', 'g') END AS text FROM pages)"""


def count_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def pattern_counts(prefix: str, source: str) -> str:
    sums = ", ".join(f"{count_if(rule('text'))} AS {name}" for name, rule in PREDICATES.items())
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS pattern, {name} AS n_hits, n_rows, {name}::DOUBLE / n_rows AS row_share FROM one"
        for name in PREDICATES
    )
    return f"WITH {prefix}, one AS (SELECT count(*) AS n_rows, {sums} FROM {source}) {rows}"


def by_class(prefix: str, source: str) -> str:
    return f"""{prefix}, rates AS (SELECT class_name, count(*) AS n_rows, {count_if(corrupt('text'))} AS n_hits
    FROM {source} GROUP BY 1), rated AS (SELECT *, n_hits::DOUBLE / n_rows AS rate FROM rates)"""


def split_of(source: str, seeds: str = "[0, 1, 2, 3, 4]") -> str:
    """Stratified split: rank in class by md5, quota by largest remainder."""
    return f"""sized AS (SELECT label, count(*) AS n FROM {source} GROUP BY 1),
quotas AS (SELECT label, n, (n * 20) // 100 AS base, (n * 20) % 100 AS rest,
    (sum(n) OVER () * 20 + 99) // 100 - sum((n * 20) // 100) OVER () AS extra FROM sized),
quota AS (SELECT label, n, base + (row_number() OVER (ORDER BY rest DESC, label) <= extra)::INT AS quota FROM quotas),
ranked AS (SELECT d.*, seed, row_number() OVER (PARTITION BY seed, label ORDER BY md5(doc_id || ':' || seed), doc_id) AS r
    FROM {source} d, (SELECT unnest({seeds}) AS seed)),
split AS (SELECT ranked.* EXCLUDE (r), CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS side
    FROM ranked JOIN quota USING (label))"""


def drawn(name: str, stream: str) -> str:
    return f"""{name} AS (SELECT seed, '{name.upper()}' AS cell, doc_id, label, prediction FROM (
    SELECT t.seed, t.doc_id, t.label, s.label AS prediction,
           row_number() OVER (PARTITION BY t.seed, t.doc_id ORDER BY s.upto, s.label) AS k
    FROM split t JOIN shares s ON t.seed = s.seed AND s.upto >
         ('0x' || substr(md5(t.doc_id || ':' || t.seed || ':{stream}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0
    WHERE t.side = 'test') WHERE k = 1)"""


PREDICTIONS = f"""{CORPUS}, {split_of('corpus')},
prior AS (SELECT seed, label, count(*) AS n FROM split WHERE side = 'train' GROUP BY 1, 2),
best AS (SELECT seed, label AS prediction FROM (
    SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n DESC, label) AS k FROM prior) WHERE k = 1),
shares AS (SELECT seed, label, sum(n) OVER (PARTITION BY seed ORDER BY label)::DOUBLE
    / sum(n) OVER (PARTITION BY seed)::DOUBLE AS upto FROM prior),
m AS (SELECT seed, 'M' AS cell, doc_id, label, prediction FROM split JOIN best USING (seed) WHERE side = 'test'),
{drawn('s', 'dummy')}, {drawn('t', 'second')},
predictions AS (SELECT * FROM m UNION ALL SELECT * FROM s UNION ALL SELECT * FROM t),
confusion AS (SELECT seed, cell, label, prediction, count(*) AS n FROM predictions GROUP BY ALL)"""
METRICS = """totals AS (SELECT seed, cell, class, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted,
    sum(tp)::BIGINT AS tp FROM (
    SELECT seed, cell, label AS class, n AS support, 0 AS predicted, CASE WHEN label = prediction THEN n ELSE 0 END AS tp
    FROM confusion UNION ALL SELECT seed, cell, prediction, 0, n, 0 FROM confusion) GROUP BY 1, 2, 3),
metrics AS (SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall,
    CASE WHEN support + predicted > 0 THEN (2 * tp)::DOUBLE / (support + predicted) ELSE 0 END AS f1 FROM totals)"""
SCORES = f"{PREDICTIONS}, {METRICS}, scores AS (SELECT seed, cell, avg(f1) AS value FROM metrics GROUP BY 1, 2)"
DELTAS = f"""{SCORES}, wide AS (SELECT seed, max(value) FILTER (WHERE cell = 'S') AS s, max(value) FILTER (WHERE cell = 'M') AS m,
    max(value) FILTER (WHERE cell = 'T') AS t FROM scores GROUP BY 1),
deltas AS (SELECT 'S' AS "left", 'M' AS "right", s - m AS d FROM wide UNION ALL SELECT 'T', 'M', t - m FROM wide
    UNION ALL SELECT 'S', 'T', s - t FROM wide),
summary AS (SELECT "left", "right", avg(d) AS mean, stddev_samp(d) AS sd, count(*) AS n, {count_if('d < 0')} AS neg,
    {count_if('d > 0')} AS pos, {count_if('d = 0')} AS zero FROM deltas GROUP BY 1, 2)"""


def near(text: str, source: str = "corpus", sides: str = "") -> str:
    """Brute force: every common term of every pair of distinct texts."""
    return f"""texts AS (SELECT min(doc_id) AS id, count(*) AS n{sides}, {text} AS t FROM {source} GROUP BY {text}),
postings AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({tokens('t')}) AS term FROM texts) GROUP BY 1, 2),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
weighted AS (SELECT id, term, tf, tf * (ln((1.0 + (SELECT count(*) FROM texts)) / (1 + df)) + 1) AS w
    FROM postings JOIN freq USING (term)),
unit AS (SELECT id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM weighted),
keyed AS (SELECT id, string_agg(term || ':' || tf, ',' ORDER BY term) AS key FROM unit GROUP BY 1),
grp AS (SELECT min(id) AS id, sum(n)::BIGINT AS n{sides.replace('count_if', 'sum').replace("(side = 'train')", '(n_train)').replace("(side = 'test')", '(n_test)')}
    FROM texts LEFT JOIN keyed USING (id) GROUP BY coalesce(key, 'id:' || id)),
gunit AS (SELECT unit.* FROM unit SEMI JOIN grp USING (id)),
cosines AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM gunit a JOIN gunit b ON a.term = b.term AND a.id < b.id
    GROUP BY 1, 2),
pairs AS (SELECT * FROM cosines WHERE cosine >= {TAU})"""


NEAR = f"{CORPUS}, {near('text')}"
CLUSTERS = f"""WITH RECURSIVE {NEAR}, edges AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, other) AS (SELECT DISTINCT x, x FROM edges UNION SELECT reach.id, edges.y FROM reach JOIN edges ON reach.other = edges.x),
clusters AS (SELECT id, min(other) AS cluster FROM reach GROUP BY 1)"""
COLLISION = f"""tok AS (SELECT class_name, case_sensitive, list_distinct(had) AS had, list_distinct(still) AS still FROM (
    SELECT class_name, true AS case_sensitive, regexp_extract_all(text, '{WORDS}{{2,}}') AS had,
           regexp_extract_all(repaired, '{WORDS}{{2,}}') AS still FROM dirty
    UNION ALL SELECT class_name, false, {tokens('text')}, {tokens('repaired')} FROM dirty)),
hit AS (SELECT class_name, case_sensitive, token, list_contains(had, token) AS had, list_contains(still, token) AS still
    FROM tok, suspects)"""


def suspects(words) -> str:
    return "suspects AS (SELECT unnest([" + ", ".join(quote(w) for w in words) + "]) AS token)"


TABLE = f"""collided AS (SELECT token, case_sensitive, {count_if('had')} AS dirty_df, {count_if('still')} AS residual
    FROM hit GROUP BY 1, 2),
judged AS (SELECT *, CASE WHEN dirty_df > 0 THEN residual::DOUBLE / dirty_df END AS ratio,
    CASE WHEN dirty_df = 0 THEN 'absent' WHEN residual = 0 THEN 'pure artifact'
         WHEN residual::DOUBLE / dirty_df > 0.95 THEN 'untouched' ELSE 'collision' END AS verdict FROM collided)"""
TITLES = "titles AS (SELECT title, count(*) AS n FROM corpus GROUP BY 1)"
SOURCED = f"""{CORPUS}, sourced AS (SELECT doc_id, title, regexp_extract(source, '(\\d+)', 1)::INT AS label FROM corpus),
tail AS (SELECT title, count(*) AS n, min(label) <> max(label) AS conflict FROM sourced GROUP BY 1 HAVING count(*) BETWEEN 2 AND 3)"""
CONFLICTS = f"count(*) AS n_titles, {count_if('conflict')} AS n_conflicts, {count_if('conflict')}::DOUBLE / count(*) AS conflict_rate"
FORTY = "forty AS (SELECT * FROM tail ORDER BY md5(title || ':0'), title LIMIT 40)"
STEPS = "[" + ", ".join(f"(SELECT count(*) FROM corpus) * {step} // 96000" for step in LADDER) + "]"
PREFIXES = f"""{CORPUS}, placed AS (SELECT doc_id, class_name, seed,
    row_number() OVER (PARTITION BY seed ORDER BY md5(doc_id || ':' || seed), doc_id) AS r
    FROM corpus, (SELECT unnest([0, 1, 2, 3, 4]) AS seed)),
stepped AS (SELECT doc_id, class_name, seed, list_min(list_filter({STEPS}, lambda k: r <= k)) AS step FROM placed)"""
TRAIN_VOCAB = f"""{DIRTY}, {split_of('dirty')}, sizes AS (
    SELECT seed, 'AB' AS side, count(DISTINCT term) AS value FROM (
        SELECT seed, unnest(list_distinct({tokens('text')})) AS term FROM split WHERE side = 'train') GROUP BY 1
    UNION ALL SELECT seed, 'CD', count(DISTINCT term) FROM (
        SELECT seed, unnest(list_distinct({tokens('repaired')})) AS term FROM split WHERE side = 'train') GROUP BY 1),
celled AS (SELECT seed, side, value, unnest(string_split(side, '')) AS cell FROM sizes)"""
HELD = f"held AS (SELECT {dirty('text')} AS text FROM benchmark)"

SEEDS = "[0, 1, 2, 3, 4]"
JUDGED = f"""{DIRTY}, judged AS (SELECT d.doc_id, l.quality AS label, d.text, d.original, d.repaired, h.half, c.title, c.description
    FROM dirty d JOIN dirty1 h USING (doc_id) JOIN corpus c USING (doc_id) JOIN labels l USING (doc_id))"""


def variant_tokens(column: str, source: str) -> str:
    """Terms of one text variant; ``~2`` behind a column adds word pairs."""
    words = f"(SELECT doc_id, {tokens(column.removesuffix('~2'))} AS t FROM {source})"
    listed = "list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))])" if column.endswith("~2") else "t"
    return f"SELECT doc_id, '{column}' AS variant, unnest({listed}) AS term FROM {words}"


def bayes_fit(cells: dict[str, tuple], source: str) -> str:
    """Multinomial naive Bayes with add-one smoothing, from ``train`` and ``test`` (seed, doc_id, label).

    ``cells`` maps a cell to its training and test column and, if wanted, the least document frequency and
    the number of most frequent terms.
    """
    columns = sorted({column for cell in cells.values() for column in cell[:2]})
    full = {name: (*cell, 1, 0)[: 4] if len(cell) == 2 else cell for name, cell in cells.items()}
    listed = ", ".join(f"('{name}', '{train}', '{test}', {low}, {top})" for name, (train, test, low, top) in full.items())
    return f"""toks AS MATERIALIZED (SELECT doc_id, variant, term, count(*) AS tf FROM ({" UNION ALL ".join(variant_tokens(c, source) for c in columns)}) GROUP BY ALL),
cells AS (SELECT * FROM (VALUES {listed}) v(cell, train, test, low, top)),
grown AS (SELECT seed, variant, label, term, sum(tf) AS c, count(*) AS df FROM toks JOIN train USING (doc_id) GROUP BY ALL),
kept AS (SELECT seed, cell, term FROM (SELECT *, row_number() OVER (PARTITION BY seed, cell ORDER BY total DESC, term) AS r FROM (
    SELECT seed, cell, term, sum(df) AS df, sum(c) AS total, any_value(low) AS low, any_value(top) AS top
    FROM grown JOIN cells ON variant = train GROUP BY ALL) WHERE df >= low) WHERE top = 0 OR r <= top),
counted AS (SELECT g.seed, cell, label, term, c FROM grown g JOIN cells ON variant = train SEMI JOIN kept k ON k.seed = g.seed AND k.cell = cells.cell AND k.term = g.term),
width AS (SELECT seed, cell, count(*) AS v FROM kept GROUP BY 1, 2),
mass AS (SELECT seed, cell, label, sum(c) AS t FROM counted GROUP BY 1, 2, 3),
prior AS (SELECT seed, label, ln(count(*) + 1.0) AS p FROM train GROUP BY 1, 2),
asked AS (SELECT seed, cell, doc_id, term, tf FROM toks JOIN cells ON variant = test JOIN test USING (doc_id)),
known AS (SELECT a.seed, a.cell, doc_id, sum(tf) AS k FROM asked a JOIN kept w ON w.seed = a.seed AND w.cell = a.cell AND w.term = a.term GROUP BY ALL),
match AS (SELECT a.seed, a.cell, doc_id, label, sum(tf * ln(c + 1.0)) AS m FROM asked a
    JOIN counted w ON w.seed = a.seed AND w.cell = a.cell AND w.term = a.term GROUP BY ALL),
score AS (SELECT x.seed, cells.cell, x.doc_id, x.label AS truth, prior.label,
    p + coalesce(m, 0) - coalesce(k, 0) * ln((coalesce(t, 0) + v)::DOUBLE) AS s
    FROM test x CROSS JOIN cells JOIN width ON width.seed = x.seed AND width.cell = cells.cell JOIN prior ON prior.seed = x.seed
    LEFT JOIN mass ON mass.seed = x.seed AND mass.cell = cells.cell AND mass.label = prior.label
    LEFT JOIN match ON match.seed = x.seed AND match.cell = cells.cell AND match.doc_id = x.doc_id AND match.label = prior.label
    LEFT JOIN known ON known.seed = x.seed AND known.cell = cells.cell AND known.doc_id = x.doc_id),
predicted AS (SELECT seed, cell, doc_id, truth AS label, label AS prediction FROM (
    SELECT *, row_number() OVER (PARTITION BY seed, cell, doc_id ORDER BY s DESC, label) AS k FROM score) WHERE k = 1)"""


def bayes(cells: dict[str, tuple], source: str = "judged", seeds: str = SEEDS, n: str = "5000") -> str:
    """Fits on the training side of a sample, scores on all rows outside it."""
    return f"""sampled AS (SELECT * FROM (SELECT doc_id, label, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(doc_id || ':' || seed), doc_id) AS sr
    FROM {source}, (SELECT unnest({seeds}) AS seed)) WHERE sr <= {n}),
sized AS (SELECT seed, label, count(*) AS n FROM sampled GROUP BY 1, 2),
quotas AS (SELECT seed, label, (n * 20) // 100 AS base, (n * 20) % 100 AS rest,
    (sum(n) OVER s * 20 + 99) // 100 - sum((n * 20) // 100) OVER s AS extra FROM sized WINDOW s AS (PARTITION BY seed)),
quota AS (SELECT seed, label, base + (row_number() OVER (PARTITION BY seed ORDER BY rest DESC, label) <= extra)::INT AS quota FROM quotas),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY md5(doc_id || ':' || seed), doc_id) AS r FROM sampled),
train AS (SELECT seed, doc_id, label FROM ranked JOIN quota USING (seed, label) WHERE r > quota),
test AS (SELECT seed, doc_id, label FROM {source} CROSS JOIN (SELECT unnest({seeds}) AS seed) AS every ANTI JOIN train USING (seed, doc_id)),
{bayes_fit(cells, source)},
confusion AS (SELECT seed, cell, label, prediction, count(*) AS n FROM predicted GROUP BY ALL), {METRICS},
scores AS (SELECT seed, cell, avg(f1) AS value FROM metrics GROUP BY 1, 2),
prints AS (SELECT seed, substr(sha1(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)), 1, 12) AS test_idx_sha1, count(*) AS n_scored FROM test GROUP BY 1),
results AS (SELECT cell, scores.seed AS seed, round(value, 6) AS macro_f1, v AS vocab_size, test_idx_sha1 FROM scores
    JOIN width USING (seed, cell) JOIN prints USING (seed))"""


def bayes_deltas(contrasts: list[tuple[str, str]]) -> str:
    """Paired deltas of the scores, after ``bayes``."""
    lefts, rights = ([f"'{pair[k]}'" for pair in contrasts] for k in (0, 1))
    return f"""pair AS (SELECT unnest([{', '.join(lefts)}]) AS "left", unnest([{', '.join(rights)}]) AS "right"),
        d AS (SELECT "left", "right", l.value - r.value AS d FROM pair JOIN scores l ON l.cell = "left" JOIN scores r ON r.cell = "right" AND r.seed = l.seed),
        z AS (SELECT "left", "right", avg(d) AS mean, stddev_samp(d) AS sd, count(*) AS n, {count_if('d < 0')} AS neg, {count_if('d > 0')} AS pos,
        {count_if('d = 0')} AS zero FROM d GROUP BY 1, 2)
        SELECT "left", "right", round(mean, 6) AS mean, round(sd, 6) AS sd, n, neg, pos, zero, abs(mean) < sd / sqrt(n) AS inside_se,
        CASE WHEN pos > neg THEN 'pos' WHEN neg > pos THEN 'neg' ELSE 'tied' END AS majority FROM z"""


TWO_BY_TWO = {"A": ("text", "text"), "B": ("text", "repaired"), "C": ("repaired", "text"), "D": ("repaired", "repaired")}
RECORDED = TWO_BY_TWO | {"B0": ("text", "half"), "C0": ("half", "text"), "D0": ("half", "half")}
PLAIN = {"D": ("repaired", "repaired")}
FIELDS = {"T": ("title", "title"), "D": ("description", "description"), "J": ("original", "original")}
MARKED = {"M": ("original", "original"), "U": ("unmarked", "unmarked")}
UNMARKED = f"{JUDGED}, marked AS (SELECT *, regexp_replace(original, " + quote(MARKERS) + ", ' ', 'g') AS unmarked FROM judged)"
MARKUP = {"R": ("repaired", "repaired"), "S": ("stripped", "stripped")}
PAGE_ARMS = f"""{ESCAPED_PAGES}, pages4 AS (SELECT p.page_id AS doc_id, CASE WHEN starts_with(url, 'http:') THEN 1 ELSE 0 END AS label, {restored('text')} AS half
    FROM pages3 p JOIN pages USING (page_id)),
pages5 AS (SELECT doc_id, label, {unescaped('half')} AS repaired FROM pages4),
arms AS (SELECT *, regexp_replace(repaired, '<\\s*/?[A-Za-z][^>]*>', ' ', 'g') AS stripped FROM pages5)"""
SETTINGS = {"default": ("text", "text", 1, 0), "min_df_2": ("text", "text", 2, 0), "min_df_5": ("text", "text", 5, 0), "top_5000": ("text", "text", 1, 5000)}
BIGRAMS = {"1": ("text", "text", 2, 0), "2": ("text~2", "text~2", 2, 0)}
CURVE_LADDER = ", ".join(f"(SELECT count(*) FROM pool) * {k} // 96000" for k in LADDER)
CURVE = f"""{JUDGED}, size AS (SELECT count(*) // 5 AS n FROM judged),
held AS (SELECT doc_id, label, anchor FROM (SELECT doc_id, label, anchor, row_number() OVER (PARTITION BY anchor ORDER BY md5(doc_id || ':' || anchor), doc_id) AS r
    FROM judged, (SELECT unnest([100, 200]) AS anchor)) WHERE r <= (SELECT n FROM size)),
pool AS (SELECT doc_id, label FROM judged ANTI JOIN held USING (doc_id)),
steps AS (SELECT unnest([{CURVE_LADDER}]) AS step),
placed AS (SELECT doc_id, label, s, row_number() OVER (PARTITION BY s ORDER BY md5(doc_id || ':' || s), doc_id) AS r
    FROM pool, (SELECT unnest(range(10)) AS s)),
train AS (SELECT s * 100000000 + step AS seed, doc_id, label FROM placed JOIN steps ON r <= step),
test AS (SELECT s * 100000000 + step AS seed, doc_id, label FROM (SELECT DISTINCT doc_id, label FROM held), steps, (SELECT unnest(range(10)) AS s)),
{bayes_fit({'x': ('repaired', 'repaired')}, 'judged')},
confusion AS (SELECT seed, anchor AS cell, p.label, prediction, count(*) AS n FROM predicted p JOIN held USING (doc_id) GROUP BY ALL), {METRICS}"""


ORACLE = {
    "corpus_profile": f"""WITH {CORPUS} SELECT count(*) AS n_rows, count(DISTINCT label) AS n_labels,
        sum((label IS NULL)::INT + (title IS NULL)::INT + (description IS NULL)::INT)::BIGINT AS n_nulls,
        round(avg(length(text)), 6) AS len_mean, round(stddev_samp(length(text)), 6) AS len_sd, min(length(text)) AS len_min,
        median(length(text)) AS len_median, max(length(text)) AS len_max FROM corpus""",
    "exact_dupes": f"WITH {CORPUS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) - count(DISTINCT {c}) AS n_dupes FROM corpus" for c in ("text", "title", "description")),
    "class_balance": """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
        SELECT source, n, n * (SELECT count(*) FROM c) = (SELECT sum(n) FROM c) AS balanced FROM c""",
    "label_domain": "SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'fr', 'de') GROUP BY 1",
    "class_sum_identity": f"""WITH {by_class(PAGES, 'pages2')} SELECT sum(n_hits)::BIGINT AS sum_of_classes,
        (SELECT {count_if(corrupt('text'))} FROM pages2) AS total, sum(n_hits) = (SELECT {count_if(corrupt('text'))} FROM pages2) AS exact FROM rates""",
    "pattern_counts": pattern_counts(PAGES, "pages2"),
    "pattern_counts_documents": pattern_counts(DIRTY, "dirty"),
    "corruption_by_class": f"WITH {by_class(DIRTY, 'dirty')} SELECT * FROM rated",
    "corruption_by_page_class": f"WITH {by_class(PAGES, 'pages2')} SELECT * FROM rated",
    "provenance_grid": f"""WITH {CORPUS}, cut AS (SELECT regexp_replace(title, '&+', 'amp;', 'g') AS title,
        regexp_replace(description, '&+', 'amp;', 'g') AS description FROM corpus),
        forms AS (SELECT true AS stripped, {STRIP.format('title')} || ' ' || {STRIP.format('description')} AS t FROM cut
        UNION ALL SELECT false, title || ' ' || description FROM cut)
        SELECT stripped, 'canonical' AS pattern, {count_if(corrupt('t'))} AS n_hits FROM forms GROUP BY 1
        UNION ALL SELECT stripped, 'loose', {count_if(loose('t'))} FROM forms GROUP BY 1""",
    "pattern_counts_glued": pattern_counts(GLUED, "glued"),
    "word_rows": r"""SELECT lang, count_if(regexp_matches(text, '(?:^|[^\p{L}\p{N}_])The(?:$|[^\p{L}\p{N}_])')) AS n_cased,
        count_if(regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])the(?:$|[^\p{L}\p{N}_])')) AS n_any_case FROM documents GROUP BY 1""",
    "label_rows_contract": """SELECT count(*) AS n_rows, count(DISTINCT doc_id) = count(*) AS unique_ids,
        count_if(quality NOT IN (0, 1) OR toxic NOT IN (0, 1)) AS n_outside FROM labels""",
    "loose_minus_strict": f"""WITH {GLUED}
        SELECT doc_id, class_name, md5(text) AS text_md5 FROM glued WHERE {loose('text')} AND NOT {corrupt('text')}""",
    "markup_by_class": f"""WITH {ESCAPED_PAGES}, c AS (SELECT class_name, count(*) AS n_rows, {count_if(markup('text'))} AS n_markup,
        {count_if(markup('text') + ' AND ' + intact('text'))} AS n_also_intact FROM pages3 GROUP BY 1),
        r AS (SELECT *, n_markup::DOUBLE / n_rows AS rate FROM c)
        SELECT *, (SELECT sum(n_rows)::BIGINT FROM r) AS all_rows, (SELECT sum(n_markup)::BIGINT FROM r) AS all_markup,
        (SELECT CASE WHEN min(rate) > 0 THEN max(rate) / min(rate) END FROM r) AS spread FROM r""",
    "entity_census": f"""WITH {DIRTY} SELECT codepoint, count(*) AS occurrences FROM (
        SELECT unnest(regexp_extract_all(text, '#(\\p{{Nd}}{{2,4}});', 1)) AS codepoint FROM dirty) GROUP BY 1""",
    "unrepaired_census": f"""WITH {DIRTY} SELECT codepoint, count(*) AS occurrences FROM (
        SELECT unnest(regexp_extract_all(repaired, '#(\\p{{Nd}}{{2,4}});', 1)) AS codepoint FROM dirty) GROUP BY 1""",
    "row_vs_occurrence_share": f"""WITH {DIRTY}, c AS (SELECT text, regexp_extract_all(text, '#(\\p{{Nd}}{{2,4}});', 1) AS nums
        FROM dirty WHERE {corrupt('text')}), s AS (SELECT {count_if("contains(text, '#233;')")} AS rows_with_entity, count(*) AS corrupt_rows,
        sum(len(list_filter(nums, lambda x: x = '233')))::BIGINT AS entity_occurrences, sum(len(nums))::BIGINT AS numeric_occurrences FROM c)
        SELECT *, rows_with_entity::DOUBLE / corrupt_rows AS share_of_rows,
        entity_occurrences::DOUBLE / numeric_occurrences AS share_of_occurrences FROM s""",
    "class_skew": f"""WITH {by_class(DIRTY, 'dirty')}, pair AS (SELECT a.class_name AS low_class, b.class_name AS high_class,
        b.rate - a.rate AS skew FROM rated a JOIN rated b ON a.class_name <> b.class_name)
        SELECT * FROM pair ORDER BY skew DESC, low_class, high_class DESC LIMIT 1""",
    "rate_interval": f"""WITH {by_class(DIRTY, 'dirty')}, z AS (SELECT *, 1.96 AS z, n_rows::DOUBLE AS n FROM rated)
        SELECT class_name, n_rows, n_hits, rate,
        round((rate + z*z/(2*n) - z*sqrt(rate*(1-rate)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low,
        round((rate + z*z/(2*n) + z*sqrt(rate*(1-rate)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM z""",
    "repair_text": f"""WITH {DIRTY} SELECT doc_id, md5(repaired) AS repaired_md5, length(repaired) AS repaired_chars,
        repaired = original AS as_original FROM dirty""",
    "unescape_text": f"SELECT page_id, {unescaped('html')} AS unescaped FROM pages",
    "markup_strip": f"""WITH {PAGES}, r AS (SELECT page_id, {unescaped(restored('text'))} AS repaired FROM pages2)
        SELECT page_id, regexp_replace(repaired, '<\\s*/?[A-Za-z][^>]*>', ' ', 'g') AS stripped FROM r""",
    "tokens_df": f"""WITH {CORPUS} SELECT term, count(*) AS df FROM (
        SELECT unnest(list_distinct({tokens('text')})) AS term FROM corpus) GROUP BY 1""",
    "token_streams": f"""SELECT conv_id, turn, array_to_string({tokens('text')}, ' ') AS tokens,
        len({tokens('text')}) AS n_tokens FROM conversations""",
    "collision_table": f"WITH {DIRTY}, {suspects(SUSPECTS)}, {COLLISION}, {TABLE} SELECT * FROM judged",
    "collision_case_diff": f"""WITH {DIRTY}, {suspects(('an', 're', 'on', 'in', 'the', '36', 'amp'))}, {COLLISION}, {TABLE}
        SELECT * FROM (SELECT token, max(residual) FILTER (WHERE case_sensitive) AS residual_cased,
        max(residual) FILTER (WHERE NOT case_sensitive) AS residual_uncased FROM judged GROUP BY 1)
        WHERE residual_cased <> residual_uncased""",
    "collision_targets": f"""WITH {DIRTY}, {suspects(SUSPECTS)}, {COLLISION}, {TABLE}
        SELECT token, case_sensitive FROM judged WHERE verdict = 'collision' AND dirty_df >= 20""",
    "class_profile": f"""WITH {DIRTY}, {suspects(SUSPECTS)}, {COLLISION}, c AS (SELECT token, case_sensitive, class_name,
        {count_if('had AND NOT still')} AS n_corrupted, {count_if('still')} AS n_genuine FROM hit WHERE had OR still GROUP BY 1, 2, 3),
        s AS (SELECT *, sum(n_corrupted) OVER w AS lost, sum(n_genuine) OVER w AS kept FROM c WINDOW w AS (PARTITION BY token, case_sensitive))
        SELECT token, case_sensitive, class_name, n_corrupted, n_genuine,
        CASE WHEN lost > 0 THEN n_corrupted::DOUBLE / lost::DOUBLE END AS corrupted_share,
        CASE WHEN kept > 0 THEN n_genuine::DOUBLE / kept::DOUBLE END AS genuine_share,
        lost::DOUBLE / greatest(kept, 1)::DOUBLE AS corrupted_per_genuine FROM s""",
    "vocab_diff": f"""WITH {DIRTY}, forms AS MATERIALIZED (SELECT text, repaired FROM dirty),
        marked AS (SELECT unnest(list_distinct({tokens('text')})) AS term, 1 AS b, 0 AS a FROM forms
            UNION ALL SELECT unnest(list_distinct({tokens('repaired')})), 0, 1 FROM forms),
        seen AS (SELECT term, sum(b)::BIGINT AS b, sum(a)::BIGINT AS a FROM marked GROUP BY 1)
        SELECT term, CASE WHEN a = 0 THEN 'lost' ELSE 'gained' END AS direction, a + b AS df FROM seen WHERE a = 0 OR b = 0""",
    "vocab_size": f"""WITH {CORPUS} SELECT class_name, count(DISTINCT term) AS vocab_size FROM (
        SELECT class_name, unnest({tokens('text')}) AS term FROM corpus) GROUP BY 1""",
    "tfidf_weights": f"""WITH {CORPUS}, p AS (SELECT doc_id, term, count(*) AS tf FROM (
        SELECT doc_id, unnest({tokens('text')}) AS term FROM corpus) GROUP BY 1, 2),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
        w AS (SELECT doc_id, term, tf, tf * (ln((1.0 + (SELECT count(*) FROM corpus)) / (1 + df)) + 1) AS w FROM p JOIN f USING (term))
        SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
    "token_log_odds": f"""WITH {CORPUS}, c AS (SELECT term, class_name, count(*) AS n_in FROM (
        SELECT class_name, unnest(list_distinct({tokens('text')})) AS term FROM corpus) GROUP BY 1, 2),
        s AS (SELECT class_name, count(*) AS rows_in, (SELECT count(*) FROM corpus) AS rows_all FROM corpus GROUP BY 1),
        t AS (SELECT *, sum(n_in) OVER (PARTITION BY term) AS n_all FROM c JOIN s USING (class_name))
        SELECT term, class_name, n_in, n_all::BIGINT AS n_all, round(ln((n_in + 0.5)::DOUBLE / (rows_in - n_in + 0.5)::DOUBLE)
        - ln((n_all - n_in + 0.5)::DOUBLE / (rows_all - rows_in - (n_all - n_in) + 0.5)::DOUBLE), 6) AS log_odds FROM t""",
    "oov_flags": f"""WITH {CORPUS}, known AS (SELECT DISTINCT unnest({tokens('text')}) AS term FROM corpus),
        turns AS (SELECT conv_id || '-' || turn AS doc_id, text FROM conversations),
        tok AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM turns),
        u AS (SELECT doc_id, count(*) AS n_tokens, {count_if('known.term IS NULL')} AS n_unknown FROM tok LEFT JOIN known USING (term) GROUP BY 1)
        SELECT doc_id, length(text) < 100 AS below_training_length_floor, length(text) = 0 OR length(text) > 5000 AS rejected,
        coalesce(n_tokens, 0) AS n_tokens, coalesce(n_unknown, 0) AS n_unknown, n_unknown::DOUBLE / n_tokens AS oov_fraction
        FROM turns LEFT JOIN u USING (doc_id)""",
    "dup_titles_units": f"""WITH {CORPUS}, {TITLES} SELECT {count_if('n > 1')} AS distinct_titles,
        coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS rows_involved, sum(n - 1)::BIGINT AS rows_beyond_first FROM titles""",
    "dup_title_head": f"WITH {CORPUS}, {TITLES} SELECT * FROM titles ORDER BY n DESC, title LIMIT 8",
    "dup_title_head_share": f"""WITH {CORPUS}, {TITLES}, s AS (SELECT (SELECT sum(n)::BIGINT FROM (SELECT n FROM titles ORDER BY n DESC, title LIMIT 8)) AS head_rows,
        (SELECT coalesce(sum(n), 0)::BIGINT FROM titles WHERE n > 1) AS rows_involved)
        SELECT *, head_rows::DOUBLE / rows_involved AS head_share FROM s""",
    "tail_label_conflicts": f"WITH {SOURCED}, {FORTY} SELECT {CONFLICTS} FROM forty",
    "syndication_conflicts": f"WITH {SOURCED} SELECT {CONFLICTS} FROM tail",
    "rows_beyond_first": f"""WITH {CORPUS} SELECT doc_id, title FROM (
        SELECT doc_id, title, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS k FROM corpus) WHERE k > 1""",
    "sampled_title_rows": f"WITH {SOURCED}, {FORTY} SELECT title, doc_id, label, conflict FROM sourced JOIN forty USING (title)",
    "sample_n": f"""WITH {CORPUS} SELECT doc_id, label FROM corpus ORDER BY md5(doc_id || ':0'), doc_id
        LIMIT (SELECT count(*) // 2 FROM documents)""",
    "stratified_split": f"WITH {CORPUS}, {split_of('corpus')} SELECT doc_id, label, seed, side FROM split",
    "split_fingerprint": f"""WITH {CORPUS}, {split_of('corpus')} SELECT seed,
        substr(sha1(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)), 1, 12) AS fingerprint FROM split WHERE side = 'test' GROUP BY 1""",
    "nested_prefixes": f"WITH {PREFIXES} SELECT doc_id, seed, step FROM stepped",
    "prefix_sizes": f"WITH {PREFIXES} SELECT seed, step, class_name, count(*) AS n_added FROM stepped WHERE step IS NOT NULL GROUP BY 1, 2, 3",
    "review_sheet": f"WITH {CORPUS} SELECT doc_id, text FROM corpus ORDER BY md5(doc_id || ':0'), doc_id LIMIT 100",
    "resample_floor": "WITH " + SCORES.replace("[0, 1, 2, 3, 4]", "[0, 1, 2, 3, 4, 5, 6, 7, 8, 9]") + """
        SELECT count(*) AS n_seeds, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM scores WHERE cell = 'S'""",
    "majority_dummy_macro_f1": f"WITH {SCORES} SELECT seed, cell, round(value, 6) AS value FROM scores WHERE cell = 'M'",
    "stratified_dummy_macro_f1": f"WITH {SCORES} SELECT seed, cell, round(value, 6) AS value FROM scores WHERE cell = 'S'",
    "confusion": f"WITH {PREDICTIONS} SELECT * FROM confusion",
    "class_metrics": f"WITH {PREDICTIONS}, {METRICS} SELECT * FROM metrics",
    "confusable_pair": f"""WITH {PREDICTIONS}, p AS (SELECT seed, cell, least(label, prediction) AS class_a, greatest(label, prediction) AS class_b,
        sum(n)::BIGINT AS n FROM confusion WHERE label <> prediction GROUP BY 1, 2, 3, 4)
        SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY seed, cell ORDER BY n DESC, class_a DESC, class_b DESC) AS k FROM p) WHERE k = 1""",
    "cell_means": f"""WITH {SCORES} SELECT cell, round(avg(value), 6) AS mean,
        string_agg(printf('%.6f', value), ' ' ORDER BY seed) AS by_seed FROM scores GROUP BY 1""",
    "paired_delta": f"""WITH {DELTAS}, j AS (SELECT *, abs(mean) < sd / sqrt(n) AS inside_se,
        CASE WHEN pos > neg THEN 'pos' WHEN neg > pos THEN 'neg' ELSE 'tied' END AS majority FROM summary)
        SELECT "left", "right", round(mean, 6) AS mean, round(sd, 6) AS sd, n, neg, pos, zero, inside_se, majority,
        "left" || '-' || "right" || '  ' || printf('%+.6f', mean) || '  sd ' || printf('%.6f', sd) || '  neg ' || neg || ' pos ' || pos
        || CASE WHEN zero <> 0 THEN ' zero ' || zero ELSE '' END || ' of ' || n || ' (' || majority || ')'
        || CASE WHEN inside_se THEN '  <- mean inside its own se; the sign count is noise' ELSE '' END AS line FROM j""",
    "missing_cells": f"""WITH {SCORES}, kept AS (SELECT * FROM scores WHERE cell <> 'T' OR seed % 2 = 0)
        SELECT seed, cell FROM (SELECT DISTINCT seed FROM kept), (SELECT unnest(['M', 'S', 'T']) AS cell)
        EXCEPT SELECT seed, cell FROM kept""",
    "telescoping": f"""WITH {DELTAS} SELECT seed, abs((s - m) + (m - t) - (s - t)) <= 1e-12 AS within_tolerance FROM wide""",
    "noise_floor": f"""WITH {DELTAS}, g AS (SELECT cell AS "left", stddev_samp(value) AS marginal_sd FROM scores GROUP BY 1)
        SELECT "left", "right", round(sd, 6) AS paired_sd, round(marginal_sd, 6) AS marginal_sd,
        round(CASE WHEN sd <> 0 THEN marginal_sd / sd END, 6) AS resolution_gain FROM summary JOIN g USING ("left")""",
    "halt_mismatches": f"""WITH {SCORES}, c AS (SELECT seed, label, count(*) AS n FROM split WHERE side = 'test' GROUP BY 1, 2),
        e AS (SELECT seed, max(n)::DOUBLE / sum(n)::DOUBLE AS p, count(*) AS k FROM c GROUP BY 1),
        x AS (SELECT seed, unnest(['M', 'S']) AS cell, 2 * p / (1 + p) / k AS expected FROM e)
        SELECT seed, cell, round(expected, 6) AS expected, round(value, 6) AS value FROM x LEFT JOIN scores USING (seed, cell)
        WHERE value IS NULL OR abs(value - expected) > 1e-9""",
    "train_vocab_sizes": f"WITH {TRAIN_VOCAB} SELECT seed, cell, value FROM celled",
    "shared_vocab_check": f"""WITH {JUDGED}, {bayes(TWO_BY_TWO)} SELECT seed, CASE WHEN cell IN ('A', 'B') THEN 'AB' ELSE 'CD' END AS side,
        count(DISTINCT v) AS n_values FROM width GROUP BY 1, 2""",
    "halt_conditions": f"""WITH {JUDGED}, {bayes(RECORDED)} SELECT seed, cell, round(o.value, 6) AS expected, round(n.value, 6) AS value
        FROM scores n JOIN (SELECT seed, replace(cell, '0', '') AS cell, value FROM scores WHERE cell LIKE '_0') o USING (seed, cell) WHERE abs(n.value - o.value) > 1e-9""",
    "resample_floors": f"""WITH {JUDGED}, {bayes(PLAIN, seeds='range(10)', n='(SELECT count(*) FROM judged)')}
        SELECT 'full' AS size, count(*) AS n_seeds, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM scores UNION ALL
        SELECT * FROM (WITH {JUDGED}, {bayes(PLAIN, seeds='range(10)', n='(SELECT count(*) // 2 FROM judged)')}
        SELECT 'half' AS size, count(*) AS n_seeds, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM scores)""",
    "shared_split_check": f"""WITH {PREDICTIONS}, f AS (SELECT seed, cell, sha1(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS h
        FROM predictions GROUP BY 1, 2) SELECT seed, count(DISTINCT h) AS n_values FROM f GROUP BY 1""",
    "results_log": f"WITH {SCORES} SELECT seed, cell, round(value, 6) AS value FROM scores WHERE cell <> 'M'",
    "results_union": f"""WITH {SCORES} SELECT 'dummy' AS experiment, cell, seed, round(value, 6) AS macro_f1, NULL::BIGINT AS vocab_size FROM scores
        UNION ALL SELECT 'vocabulary', class_name, NULL, NULL, count(DISTINCT term) FROM (
        SELECT class_name, unnest({tokens('text')}) AS term FROM corpus) GROUP BY class_name""",
    "neardup_cost": f"""WITH {NEAR} SELECT CASE WHEN df < {LOW} THEN 'below' WHEN df * 100 > (SELECT count(*) FROM texts) * {PERCENT} THEN 'above' ELSE 'band' END AS part,
        count(*) AS n_terms, sum(df)::BIGINT AS n_postings, sum(df * (df - 1) // 2)::BIGINT AS n_pairs FROM freq GROUP BY 1""",
    "neardup_pairs": f"WITH {NEAR} SELECT a, b, round(cosine, 6) AS cosine FROM pairs",
    "neardup_group_sizes": f"WITH {NEAR} SELECT id, n FROM grp WHERE n > 1",
    "neardup_sweep": f"""WITH {NEAR}, th AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in SWEEP)}]) AS threshold),
        ends AS (SELECT id, max(cosine) AS best FROM (SELECT a AS id, cosine FROM pairs UNION ALL SELECT b, cosine FROM pairs) GROUP BY 1),
        x AS (SELECT threshold, sum(ga.n * gb.n) AS across FROM th JOIN pairs ON cosine >= threshold JOIN grp ga ON ga.id = a JOIN grp gb ON gb.id = b GROUP BY 1)
        SELECT threshold, (sum(n * (n - 1) // 2) + coalesce(max(across), 0))::BIGINT AS n_pairs,
        sum(CASE WHEN n > 1 OR best >= threshold THEN n ELSE 0 END)::BIGINT AS rows_involved
        FROM th CROSS JOIN grp LEFT JOIN ends USING (id) LEFT JOIN x USING (threshold) GROUP BY 1""",
    "neardup_clusters": f"{CLUSTERS} SELECT id, cluster FROM clusters",
    "neardup_classes": f"""{CLUSTERS} SELECT cluster, count(*) AS n_vectors, sum(n)::BIGINT AS n_rows FROM clusters JOIN grp USING (id) GROUP BY 1""",
    "neardup_units": f"""{CLUSTERS}, z AS (SELECT coalesce(cluster, id) AS cluster, sum(n) AS r FROM grp LEFT JOIN clusters USING (id) GROUP BY 1)
        SELECT count(*) AS n_clusters, sum(r)::BIGINT AS rows_involved, sum(r - 1)::BIGINT AS rows_beyond_first FROM z WHERE r > 1""",
    "neardup_cross_split": f"""WITH {CORPUS}, {split_of('corpus', '[0]')},
        {near('text', 'split', sides=", count_if(side = 'train') AS n_train, count_if(side = 'test') AS n_test")}
        SELECT ((SELECT coalesce(sum(ga.n_train * gb.n_test + ga.n_test * gb.n_train), 0) FROM pairs JOIN grp ga ON ga.id = a JOIN grp gb ON gb.id = b)
        + (SELECT sum(n_train * n_test) FROM grp))::BIGINT AS n_cross_pairs""",
    "neardup_precision_sample": f"""WITH {NEAR} SELECT a, b, round(cosine, 6) AS cosine, a || '-' || b AS pair FROM pairs
        ORDER BY md5(a || '-' || b || ':0'), a || '-' || b LIMIT 20""",
    "neardup_recall": f"""WITH {CORPUS}, {TITLES}, {near('description')},
        rowtext AS (SELECT c.doc_id, c.title, c.description, t.id FROM corpus c JOIN texts t ON c.description = t.t),
        truth AS (SELECT x.id AS xi, y.id AS yi FROM rowtext x JOIN rowtext y ON x.title = y.title AND x.doc_id < y.doc_id
            JOIN titles ON titles.title = x.title WHERE titles.n BETWEEN 2 AND 3),
        scored AS (SELECT xi = yi OR coalesce((SELECT sum(p.w * q.w) FROM unit p JOIN unit q ON p.term = q.term
            WHERE p.id = xi AND q.id = yi), 0) >= {TAU} AS found FROM truth)
        SELECT count(*) AS n_truth, {count_if('found')} AS n_found, {count_if('found')}::DOUBLE / count(*) AS recall FROM scored""",
    "heldout_distribution": f"""WITH {HELD} SELECT count(*) AS n_rows, {', '.join(f"{count_if(rule('text'))} AS {name}" for name, rule in PREDICATES.items())},
        min(length(text)) AS len_min, median(length(text)) AS len_median, max(length(text)) AS len_max FROM held""",
    "experiment_2x2_cells": f"""WITH {JUDGED}, {bayes(TWO_BY_TWO)} SELECT cell, seed, (SELECT least(count(*), 5000) FROM judged) AS n,
        vocab_size, test_idx_sha1, n_scored FROM results JOIN prints USING (seed, test_idx_sha1)""",
    "bayes_2x2": f"WITH {JUDGED}, {bayes(TWO_BY_TWO)} SELECT * FROM results",
    "bayes_2x2_deltas": f"""WITH {JUDGED}, {bayes(TWO_BY_TWO)}, {bayes_deltas([('A', 'B'), ('C', 'D'), ('A', 'C'), ('B', 'D')])}""",
    "bayes_class_metrics": f"""WITH {JUDGED}, {bayes(TWO_BY_TWO)} SELECT seed, cell, class, support, predicted, tp, precision, recall, f1 FROM metrics""",
    "markup_arms": f"WITH {PAGE_ARMS}, {bayes(MARKUP, 'arms')} SELECT * FROM results",
    "markup_deltas": f"WITH {PAGE_ARMS}, {bayes(MARKUP, 'arms')}, {bayes_deltas([('R', 'S')])}",
    "field_ablation": f"WITH {JUDGED}, {bayes(FIELDS)} SELECT * FROM results",
    "field_deltas": f"WITH {JUDGED}, {bayes(FIELDS)}, {bayes_deltas([('J', 'T'), ('J', 'D')])}",
    "marker_ablation": f"WITH {UNMARKED}, {bayes(MARKED, 'marked')} SELECT * FROM results",
    "marker_deltas": f"WITH {UNMARKED}, {bayes(MARKED, 'marked')}, {bayes_deltas([('M', 'U')])}",
    "settings_sweep": f"WITH {JUDGED}, {bayes(SETTINGS)} SELECT * FROM results",
    "settings_deltas": f"""WITH {JUDGED}, {bayes(SETTINGS)}, {bayes_deltas([('min_df_2', 'default'), ('min_df_5', 'default'), ('top_5000', 'default')])}""",
    "bigram_arm": f"WITH {JUDGED}, {bayes(BIGRAMS)} SELECT * FROM results",
    "learning_curve": f"""WITH {CURVE} SELECT cell AS anchor, (seed // 100000000)::INT AS seed, (seed % 100000000)::INT AS step,
        round(avg(f1), 6) AS macro_f1, any_value(v) AS vocab_size FROM metrics JOIN (SELECT seed, v FROM width) USING (seed) GROUP BY metrics.cell, seed""",
}
