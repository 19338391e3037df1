"""Queries over texts: normalisation, folding, keys, headings, counts, similarity."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from versehall.functions import passages as ps
from versehall.functions import readings as rd
from versehall.functions import speech as sp
from versehall.functions import text as tx
from versehall.operators import pages as pg
from versehall.plans.registry import plain, query, table
from versehall.sources import books

plain("f37_cache_key", "SELECT doc_id, md5(concat_ws('|', lang, source, text)) AS key FROM documents")
_FOLD = f"translate(lower({{0}}), '{tx.FOLD_FROM}', '{tx.FOLD_TO}')"
_SLUG = "regexp_replace(regexp_replace(translate(" + _FOLD + ", 'đ', 'd'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_ZERO = "".join(f"chr({ord(c)})||" for c in tx.ZERO_WIDTH)[:-2]


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(160) || '「」' || {_ZERO}, ' “”'),
  '\\[note[0-9]+\\]', '', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ')) AS digest FROM documents""")
def f1_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def f6_fold(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[\\s_]+', ' ', 'g')) AS key FROM part")
def f9_identity_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.identity_key(F.col("p_name")).alias("key"))


@query(f"SELECT page_id, {_SLUG.format('url')} AS slug FROM pages")
def f11_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, (100 + (('0x' || substr(sha256(text), 1, 16))::UBIGINT % 900))::BIGINT AS pick FROM documents")
def f13_stable_int(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.stable_int(F.col("text"), 100, 1000).alias("pick"))


@query("SELECT conv_id, turn, printf('c%05d_s%07d_%s', conv_id, turn, substr(sha256(text), 1, 12)) AS stable_id FROM conversations")
def d2_stable_id(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.stable_id(F.col("conv_id"), F.col("turn"), F.col("text")).alias("stable_id"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM l WHERE trim(line) <> '')
  SELECT doc_id, count(*) FILTER (WHERE r <= 6 AND regexp_matches(line, '(?i)licen[sc]e|copyright')) AS credits, count(*) AS lines FROM n GROUP BY doc_id""")
def f17_credit_lines(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    lines = lines.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    credit = (F.col("r") <= 6) & F.col("line").rlike("(?i)licen[sc]e|copyright")
    return lines.groupBy("doc_id").agg(F.count_if(credit).alias("credits"), F.count("*").alias("lines"))


_HEADING = "(?i)^\\s*((chapter|part)\\s+[0-9ivxlcdm]+\\b.*|[ivxlcdm]{1,7}\\.?)\\s*$"


@query(f"""WITH d AS (SELECT doc_id, text || chr(10) || 'Chapter ' || doc_id % 7 || chr(10) || lang || chr(10) || 'Part ii: ' || source || chr(10) || 'xiv.' || chr(10) || 'end' AS t FROM documents),
  l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
  g AS (SELECT *, sum(CASE WHEN pos = 1 OR regexp_matches(line, '{_HEADING}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS part FROM l)
  SELECT doc_id, part::INTEGER AS part, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM g GROUP BY doc_id, part""")
def f21_split_on_headings(spark, sf_dir):
    """Documents with three headings put behind their text."""
    more = F.concat("text", F.lit("\nChapter "), (F.col("doc_id") % 7).cast("string"), F.lit("\n"), "lang", F.lit("\nPart ii: "), "source", F.lit("\nxiv.\nend"))
    parts = books.split_on_headings(_docs(spark, sf_dir).select("doc_id", more.alias("text")))
    return parts.select("doc_id", "part", F.md5("part_text").alias("digest"))


@query("SELECT page_id, coalesce(try_cast(nullif(regexp_extract(lower(url), '/([0-9]{1,9})', 1), '') AS INTEGER), 1) AS volume FROM pages")
def f22_volume(spark, sf_dir):
    n = F.regexp_extract(F.lower("url"), "/([0-9]{1,9})", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.when(n != "", n.try_cast("int")), F.lit(1)).alias("volume"))


@query("""SELECT a.p_partkey, round(greatest(0.0, 1 - levenshtein(a.p_name, b.p_name) / greatest(1, length(a.p_name))), 6) AS sim FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def f25_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select("p_partkey", F.round(tx.similarity(F.col("p_name"), F.col("other")), 6).alias("sim"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, 'licensed under', '', 'g')), '[a-z]+')) AS word FROM documents )
  SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY word HAVING count(*) >= 20""")
def a27_bag_of_words(spark, sf_dir):
    clean = F.lower(F.regexp_replace("text", "licensed under", ""))
    words = _docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(clean, F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("n >= 20")


@query("""WITH l AS (SELECT conv_id, avg(regexp_matches(text, '(?i)(^|[^a-z])(the|a)([^a-z]|$)')::INT) AS rate FROM conversations GROUP BY conv_id)
  SELECT count(*) AS convs, round(avg(rate), 6) AS mean, round(avg((rate >= 0.3)::INT), 6) AS share FROM l""")
def a29_two_level_rate(spark, sf_dir):
    hit = F.col("text").rlike("(?i)(^|[^a-z])(the|a)([^a-z]|$)").cast("int")
    rate = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.avg(hit).alias("rate"))
    return rate.agg(F.count("*").alias("convs"), F.round(F.avg("rate"), 6).alias("mean"), F.round(F.avg((F.col("rate") >= 0.3).cast("int")), 6).alias("share"))


@query("""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z,;] ([A-Z][a-z]{3,})', 1)) AS name FROM documents)
  SELECT name, count(*) AS n, count(DISTINCT doc_id) AS docs FROM n GROUP BY name HAVING count(*) >= 2""")
def f33_proper_names(spark, sf_dir):
    names = _docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z,;] ([A-Z][a-z]{3,})"), F.lit(1))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("n >= 2")


@query("""WITH t AS (SELECT conv_id, turn, length(text) AS w, sum(length(text)) OVER (PARTITION BY conv_id) AS every,
    coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
  SELECT conv_id, turn, (60000 * before // greatest(1, every))::BIGINT AS start_ms, (60000 * (before + w) // greatest(1, every))::BIGINT AS end_ms FROM t""")
def f36_spread(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("w", F.length("text").cast("long"))
    all_, upto = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("every", F.sum("w").over(all_)).withColumn("before", F.coalesce(F.sum("w").over(upto), F.lit(0)))
    s = tx.spread_ms(F.lit(60000).cast("long"), F.col("before"), F.col("w"), F.col("every"))
    return c.select("conv_id", "turn", s["start"].alias("start_ms"), s["end"].alias("end_ms"))


@query(f"SELECT doc_id FROM documents WHERE contains(translate({_FOLD.format('text')}, 'đ', 'd'), 'eleve') OR contains(translate({_FOLD.format('source')}, 'đ', 'd'), 'src1')")
def p12_folded_search(spark, sf_dir):
    hit = tx.fold_all(F.col("text")).contains("eleve") | tx.fold_all(F.col("source")).contains("src1")
    return _docs(spark, sf_dir).where(hit).select("doc_id")


@query("""SELECT d.doc_id, b.item_id, ((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text))::BIGINT AS mentions FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)""")
def j19_containment(spark, sf_dir):
    return pg.containment(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query("""WITH d AS (SELECT source, doc_id, 'Chronicle of ' || source || ', part ' || doc_id || chr(10) || chr(10) || text || chr(10) || '- ' || doc_id % 500 || ' -' AS t FROM documents),
  l AS (SELECT source, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
  f AS (SELECT *, CASE WHEN trim(line) <> '' THEN row_number() OVER (PARTITION BY doc_id, trim(line) <> '' ORDER BY pos) END AS r, count(*) FILTER (WHERE trim(line) <> '') OVER (PARTITION BY doc_id) AS n FROM l),
  z AS (SELECT *, CASE WHEN r <= 2 OR r > n - 2 THEN regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g') END AS key FROM f),
  h AS (SELECT source, key FROM z JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) p USING (source) WHERE key IS NOT NULL GROUP BY source, key, pages HAVING count(DISTINCT doc_id) >= 3 AND pages >= 3 AND count(DISTINCT doc_id) * 5 >= pages * 2),
  k AS (SELECT z.*, h.key IS NOT NULL OR (z.key IS NOT NULL AND (r = 1 OR r = n) AND regexp_matches(line, '^[-\\s]*[0-9]{1,5}[-\\s]*$')) AS dropped FROM z LEFT JOIN h ON h.source = z.source AND h.key = z.key)
  SELECT source, doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS digest, count(*) FILTER (WHERE dropped) AS dropped FROM k GROUP BY source, doc_id""")
def f18_running_headers(spark, sf_dir):
    """Documents of a source as pages of a book, with a running head and page numbers put on."""
    head = F.concat(F.lit("Chronicle of "), "source", F.lit(", part "), F.col("doc_id").cast("string"), F.lit("\n\n"))
    foot = F.concat(F.lit("\n- "), (F.col("doc_id") % 500).cast("string"), F.lit(" -"))
    pages = _docs(spark, sf_dir).select("source", "doc_id", F.concat(head, "text", foot).alias("text"))
    return pg.drop_running_lines(pages, "source", "doc_id", "text").select("source", "doc_id", F.md5("text").alias("digest"), "dropped")


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, chr(173) || '[ \t]*\n[ \t]*(\p{Ll})', '\1', 'g'), '([^.!?…”"»’)。:;\s])[ \t]*\n[ \t]*(\p{Ll})', '\1 \2', 'g')) AS digest
  FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '([a-z]{3})([a-z]{3}) ', '\1' || chr(173) || chr(10) || '\2 ', 'g'), ', ([a-z]+ [a-z])', chr(10) || '\1', 'g') AS text FROM documents) x""")
def f19_join_wrapped(spark, sf_dir):
    """Documents with words broken by soft hyphens and lines by commas."""
    torn = F.regexp_replace(F.regexp_replace("text", "([a-z]{3})([a-z]{3}) ", "$1\u00ad\n$2 "), ", ([a-z]+ [a-z])", "\n$1")
    return _docs(spark, sf_dir).select("doc_id", F.md5(ps.join_wrapped(torn)).alias("digest"))


_TITLES = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' · Vol. ' || p_size WHEN 1 THEN p_name || ' - Phần ' || p_size WHEN 2 THEN p_name ELSE p_name || ' | book ' || p_size || ' of all' END"
_FORM = "(?i)^(.*?)\\s*[·|:—–-]\\s*(tập|quyển|phần|vol\\.?|book)\\s*([0-9]{1,9})\\b"


@query(f"""WITH b AS (SELECT p_partkey AS k, {_TITLES} AS t, CASE WHEN p_partkey % 10 = 7 THEN p_partkey - 3 END AS root, 2 AS part FROM part),
  s AS (SELECT *, regexp_matches(t, '{_FORM}') AS f, trim(CASE WHEN regexp_matches(t, '{_FORM}') THEN regexp_extract(t, '{_FORM}', 1) ELSE t END) AS name, try_cast(regexp_extract(t, '{_FORM}', 3) AS INTEGER) AS v, lower(regexp_extract(t, '{_FORM}', 2)) AS w FROM b),
  c AS (SELECT s.*, CASE WHEN f AND w IN ('quyển', 'phần') THEN w ELSE 'tập' END AS u, root IS NULL AND k IN (SELECT root FROM b WHERE root IS NOT NULL) AS is_root FROM s),
  n AS (SELECT name, arg_min(u, k) AS nu FROM c WHERE root IS NULL AND NOT is_root AND v IS NOT NULL GROUP BY name)
  SELECT c.k AS p_partkey, CASE WHEN c.root IS NOT NULL OR c.is_root THEN 'chain:' || coalesce(c.root, c.k) ELSE 'title:' || c.name END AS series_key, CASE WHEN c.root IS NOT NULL THEN coalesce(r.name, c.name) ELSE c.name END AS series,
    CASE WHEN c.root IS NOT NULL THEN c.part WHEN c.is_root OR (c.v IS NULL AND nu IS NOT NULL) THEN 1 ELSE c.v END AS volume, CASE WHEN c.root IS NOT NULL OR c.is_root THEN 'phần' WHEN c.v IS NULL AND nu IS NOT NULL THEN nu ELSE c.u END AS unit
  FROM c LEFT JOIN c r ON r.k = c.root LEFT JOIN n ON n.name = c.name""")
def f23_series_index(spark, sf_dir):
    """Parts as books: volumes by title, unnumbered ones, and chains."""
    n = F.col("p_size").cast("string")
    title = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" · Vol. "), n)).when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit(" - Phần "), n))
    title = title.when(F.col("p_partkey") % 4 == 2, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" | book "), n, F.lit(" of all")))
    b = table(spark, sf_dir, "part").select("p_partkey", title.alias("t"), F.when(F.col("p_partkey") % 10 == 7, F.col("p_partkey") - 3).alias("root"), F.lit(2).alias("part"))
    return pg.series_index(b, "p_partkey", "t", "root", "part")


@query()
def f24_f29_heard(spark, sf_dir):
    """Each turn held against the next one as what was heard of it, in two seconds a turn; edits of words
    and of accented letters are held against a plain count in the tests."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("other", F.lead("text").over(w)).where("other IS NOT NULL")
    a, b, alike = F.col("text"), F.col("other"), F.col("alike")
    c = c.withColumn("edits", ps.token_distance(a, b)).withColumn("alike", ps.likeness(a, b))
    wer = F.col("edits") / F.greatest(F.lit(1), ps.n_words(a))
    seconds = F.col("turn") * 2.0
    return c.select(
        "conv_id", "turn", F.col("edits").cast("long").alias("edits"), F.round(wer, 6).alias("wer"), ps.severe_mismatch(a, b, alike).alias("severe"),
        ps.beyond_rate(b, seconds).alias("too_fast"), ps.accepted(F.lit(True), alike, wer, 0.2, 0.9).alias("accepted"),
    )


@query()
def f34_mentions(spark, sf_dir):
    """Common words of three languages as aliases, some within others; held against a plain search."""
    names = F.array(*[F.lit(x) for x in ("the", "and the", "of the", "and", "des", "le", "und der", "der", "les")])
    spans = _docs(spark, sf_dir).select("doc_id", F.explode(ps.mention_spans(F.col("text"), names)).alias("m"))
    return spans.select("doc_id", "m.start", "m.end", "m.alias")


@query("""WITH w AS (SELECT DISTINCT w FROM (SELECT lower(unnest(regexp_extract_all(text, '\\p{L}+'))) AS w FROM documents) x WHERE regexp_full_match(w, '[ivxlcdm]+')), v AS (SELECT w, [CASE c WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END for c in string_split(w, '')] AS n FROM w)
  SELECT w AS numeral, CASE WHEN regexp_matches(w, '^m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$') THEN list_sum([CASE WHEN i < len(n) AND n[i] < n[i + 1] THEN -n[i] ELSE n[i] END for i in range(1, len(n) + 1)])::INTEGER END AS value FROM v""")
def f4_roman(spark, sf_dir):
    """Words of the documents made of numerals' letters."""
    w = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    return w.select(F.lower("w").alias("numeral")).where("numeral RLIKE '^[ivxlcdm]+$'").distinct().withColumn("value", rd.roman_value(F.col("numeral")))


_WIKI = "{{đầu đề|tên={{x}}\n|năm=1}} rest\n{{g|:Mr {{SIC|Jhon|John}} came.<ref>a  note</ref>}}\n[[File:p.jpg|thumb]]'''Bold''' [[Page|shown]] and [[plain]]<br/>.<ref>two</ref><ref name=x/>\n\n{{biên trái|2em|Inside}}"


@query(f"SELECT p_partkey, 'Mr Jhon came.[1]' || chr(10) || chr(10) || 'Bold shown and plain.[2]' || chr(10) || chr(10) || 'Inside' || chr(10) || chr(10) || '▲ a note' || chr(10) || chr(10) || '▲ ' || p_name AS text, 2 AS notes FROM part")
def src11_wikitext(spark, sf_dir):
    """A page of every construct, with a part's name in its last note."""
    source = F.replace(F.lit(_WIKI), F.lit("<ref>two"), F.concat(F.lit("<ref>"), "p_name"))
    text, notes = rd.plain_wikitext(source)
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), F.size(notes).alias("notes"))


@query()
def f2_spoken_symbols(spark, sf_dir):
    """Documents with marks put between their words; held against hand-made cases in the tests."""
    marked = F.regexp_replace("text", r"([a-z])\. ([A-Z])", "$1 ($2) » ↓ | $2")
    return _docs(spark, sf_dir).select("doc_id", sp.spoken_symbols(marked).alias("said"))
