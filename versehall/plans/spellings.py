"""Queries of the name passes over names and words of the given tables; SQL works their answers out."""

from pyspark.sql import functions as F

from versehall.functions import text as tx
from versehall.operators import entity
from versehall.plans.registry import query, table
from versehall.plans.texts import _FOLD

_PREFIXES = ["old", "small"]
_BASE = lambda c: f"translate({_FOLD.format(c)}, 'đ', 'd')"
_MARKED = ", ".join(f"'{c}': '{m}'" for c, m in tx._MARKS.items())


def _marks_sql(name: str) -> str:
    """The marks of a name as a list of place and mark."""
    letters = f"string_split(lower({name}), '')"
    return f"flatten([[(i - 1) || ':' || m for m in string_split(coalesce(MAP {{{_MARKED}}}[{letters}[i]], ''), '') if m <> ''] for i in range(1, len({letters}) + 1)])"


def _words(spark, sf_dir, name: str, pattern: str):
    rows = table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("lines"))


_ANY = r"(\p{L}{3,})"
_SPELT = rf"n AS (SELECT name, count(*) AS lines FROM (SELECT unnest(regexp_extract_all(text, '{_ANY}', 1)) AS name FROM documents) GROUP BY name), m AS (SELECT name, lines, {_BASE('name')} AS base, {_marks_sql('name')} AS marks FROM n)"


@query(f"""WITH {_SPELT} SELECT a.name, arg_max(b.name, (len(b.marks), b.lines, b.name)) AS target FROM m a JOIN m b ON a.base = b.base AND len(a.marks) < len(b.marks) AND list_has_all(b.marks, a.marks) GROUP BY a.name""")
def e2_spellings(spark, sf_dir):
    """The documents' words: which are others with marks left out."""
    return entity.dropped_marks(_words(spark, sf_dir, "documents", _ANY))


@query(f"""WITH {_SPELT}, t AS (SELECT base, arg_max(name, (lines, name)) AS of FROM m GROUP BY base), p AS (SELECT m.name, m.marks, t.of, {_marks_sql("t.of")} AS whole FROM m JOIN t USING (base) WHERE m.name <> t.of)
  SELECT name, of, len(marks) < len(whole) AND list_has_all(whole, marks) AS dropped FROM p""")
def f10_against_commonest(spark, sf_dir):
    """Words of the documents against the commonest word of the same bare letters."""
    n = _words(spark, sf_dir, "documents", _ANY).withColumn("base", tx.fold_all(F.col("name")))
    top = n.groupBy("base").agg(F.max_by("name", F.struct("lines", "name")).alias("of"))
    return n.join(top, "base").where("name <> of").select("name", "of", tx.dropped_marks_of(F.col("name"), F.col("of")).alias("dropped"))


_CAPITAL = "(?:^|[^A-Za-z])([A-Z][a-z]{3,7})"
_INSIDE = "[a-z,;] ([A-Z][a-z]{3,7})"


@query(f"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_CAPITAL}', 1)) AS name FROM conversations), w AS (SELECT name, count(*) AS hits FROM (SELECT unnest(regexp_extract_all(text, '{_INSIDE}', 1)) AS name FROM documents) GROUP BY name),
  f AS (SELECT name, lower(name) AS f FROM a WHERE name NOT IN (SELECT name FROM w)), k AS (SELECT name, lower(name) AS g FROM w WHERE hits >= 2), g AS (SELECT g, min(name) AS target, count(DISTINCT name) AS n FROM k GROUP BY g),
  p AS (SELECT f.name, f.f, g.g, g.target, g.n, levenshtein(f.f, g.g) AS e FROM f JOIN g ON levenshtein(f.f, g.g) <= 2 WHERE levenshtein(f.f, g.g) < 2 OR length(f.f) >= 5),
  u AS (SELECT name, e, any_value(target) AS target, any_value(n) AS n FROM p GROUP BY name, e HAVING count(DISTINCT g) = 1 OR e = 0)
  SELECT name, arg_min(target, (e, target)) AS target FROM u WHERE n = 1 GROUP BY name HAVING arg_min(target, (e, target)) <> name""")
def e4_e5_written_forms(spark, sf_dir):
    """Capitalised words of the conversations that the documents never write inside a sentence, to the form they do write."""
    names = _words(spark, sf_dir, "conversations", _CAPITAL)
    words = _words(spark, sf_dir, "documents", _INSIDE).withColumnRenamed("lines", "hits")
    return entity.to_source_spelling(names, words, least=2)


#: The cast: words of part names, spelt in several ways by the part's key.
_CAST = """n AS (SELECT name, count(*) AS lines FROM (SELECT unnest([w[1], w[2], rtrim(w[1] || j || w[2])]) AS name FROM (SELECT string_split(CASE p_partkey % 11 WHEN 0 THEN translate(p_name, 'eo', 'éô') WHEN 1 THEN translate(p_name, 'e', 'é')
    WHEN 2 THEN translate(p_name, 'i', 'ĩ') WHEN 3 THEN upper(p_name) WHEN 4 THEN translate(p_name, 'ea', 'ẽá') ELSE p_name END, ' ') AS w, CASE WHEN p_partkey % 5 = 0 THEN '_' ELSE ' ' END AS j FROM part)) WHERE name <> '' GROUP BY name)"""


def _spelt(part):
    k, n = F.col("p_partkey"), F.col("p_name")
    spelt = F.when(k % 11 == 0, F.translate(n, "eo", "éô")).when(k % 11 == 1, F.translate(n, "e", "é")).when(k % 11 == 2, F.translate(n, "i", "ĩ")).when(k % 11 == 3, F.upper(n)).when(k % 11 == 4, F.translate(n, "ea", "ẽá")).otherwise(n)
    w = part.select(F.split(spelt, " ").alias("w"), F.when(k % 5 == 0, "_").otherwise(" ").alias("j"))
    names = w.select(F.explode(F.array(F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.rtrim(F.concat(F.get("w", F.lit(0)), "j", F.coalesce(F.get("w", F.lit(1)), F.lit("")))))).alias("name"))
    return names.where("name <> ''").groupBy("name").agg(F.count("*").alias("lines"))


def _cast(spark, sf_dir):
    return _spelt(table(spark, sf_dir, "part"))


# Each pass as SQL over a table (name, lines), for `_passes_sql`.
_IDENTITY = "SELECT name, target FROM (SELECT name, arg_min(name, (-lines, lower(name), name)) OVER (PARTITION BY trim(regexp_replace(lower(name), '[\\s_]+', ' ', 'g'))) AS target FROM {0}) WHERE name <> target"
_DROPPED = f"SELECT a.name, arg_max(b.name, (len(b.marks), b.lines, b.name)) AS target FROM (SELECT *, {_BASE('name')} AS base, {_marks_sql('name')} AS marks FROM {{0}}) a JOIN (SELECT *, {_BASE('name')} AS base, {_marks_sql('name')} AS marks FROM {{0}}) b ON a.base = b.base AND len(a.marks) < len(b.marks) AND list_has_all(b.marks, a.marks) GROUP BY a.name"
_STRAY = "SELECT a.name, arg_min(b.name, (len(string_split(b.name, ' ')), -b.lines, b.name)) AS target FROM {0} a JOIN {0} b ON len(string_split(a.name, ' ')) >= 2 AND a.lines <= 30 AND starts_with(a.name, b.name || ' ') AND b.lines >= 10 * greatest(1, a.lines) GROUP BY a.name"
_OLD = ", ".join(f"'{p}'" for p in _PREFIXES)
_FULL = f"(SELECT name AS of, string_split(lower(name), ' ')[-1] AS l FROM {{0}} WHERE len(string_split(name, ' ')) > 1 AND string_split(lower(name), ' ')[1] NOT IN ({_OLD}, ''))"
_GIVEN = f"""SELECT name, CASE WHEN x.n IS NOT NULL THEN CASE WHEN x.n = 1 THEN x.target END WHEN {_BASE('o.l')} = o.l AND y.n = 1 THEN y.target END AS target FROM (SELECT name, lower(name) AS l FROM {{0}} WHERE len(string_split(name, ' ')) = 1 AND name <> '') o
  LEFT JOIN (SELECT l, count(DISTINCT of) AS n, min(of) AS target FROM {_FULL} GROUP BY l) x ON x.l = o.l LEFT JOIN (SELECT {_BASE('l')} AS l, count(DISTINCT of) AS n, min(of) AS target FROM {_FULL} GROUP BY 1) y ON y.l = o.l
  WHERE (x.n = 1) OR (x.n IS NULL AND {_BASE('o.l')} = o.l AND y.n = 1)"""


def _passes_sql(passes: list[str]) -> str:
    """(name, canonical) after the passes, each over the names that stand when it begins."""
    steps = ["s0 AS (SELECT name, name AS canonical FROM n)"]
    for i, one in enumerate(passes):
        steps.append(f"l{i} AS MATERIALIZED (SELECT DISTINCT canonical AS name, coalesce(n.lines, 0) AS lines FROM s{i} LEFT JOIN n ON n.name = canonical)")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT s.name, coalesce(m.target, s.canonical) AS canonical FROM s{i} s LEFT JOIN ({one.replace('{0}', f'l{i}')}) m ON m.name = s.canonical)")
    return ", ".join(steps)


@query(f"""WITH {_CAST}, {_passes_sql([_IDENTITY, _DROPPED, _STRAY, _GIVEN])} SELECT s.name, CASE WHEN s.name = upper(s.name) AND s.name LIKE 'R%' THEN 'confirmed ' || s.name ELSE canonical END AS canonical FROM s4 s""")
def e1_passes(spark, sf_dir):
    """Identity, marks, stray surnames and given names in order, then confirmed aliases, for the whole cast."""
    names = _cast(spark, sf_dir)
    confirmed = names.where("name = upper(name) AND name LIKE 'R%'").select("name", F.concat(F.lit("confirmed "), "name").alias("target"))
    passes = [entity.by_identity, entity.dropped_marks, lambda n: entity.stray_surnames(n, most=30), lambda n: entity.given_to_full(n, _PREFIXES)]
    return entity.resolve(names, passes, confirmed)


_SPARSE = _CAST.replace("FROM part", "FROM part WHERE p_partkey % 17 = 0 OR p_partkey % 40 = 3")


@query(f"WITH {_SPARSE} {_GIVEN.replace('{0}', 'n')}")
def e6_given_names(spark, sf_dir):
    """Single words to the only name of two that ends in them, among the cast of every 17th part and some more."""
    t = table(spark, sf_dir, "part").where("p_partkey % 17 = 0 OR p_partkey % 40 = 3")
    return entity.given_to_full(_spelt(t), _PREFIXES)


@query(f"""WITH {_SPARSE}, w AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 301 = 5), p AS (SELECT DISTINCT name AS full_, unnest([string_split(lower(name), ' ')[1], string_split(lower(name), ' ')[-1]]) AS w FROM w WHERE len(string_split(name, ' ')) > 1),
  o AS (SELECT w, min(full_) AS full_ FROM p GROUP BY w HAVING count(DISTINCT full_) = 1), k AS (SELECT name, trim(regexp_replace(lower(name), '[\\s_]+', ' ', 'g')) AS k FROM n)
  SELECT n.name, coalesce(k.name, o.full_) AS target FROM n JOIN o ON lower(n.name) = o.w LEFT JOIN k ON k.k = trim(regexp_replace(lower(o.full_), '[\\s_]+', ' ', 'g')) WHERE len(string_split(n.name, ' ')) = 1""")
def e6_written_names(spark, sf_dir):
    """Single words of the cast to the only part name of another sample that holds them, as the cast spells it."""
    p = table(spark, sf_dir, "part")
    written = p.where("p_partkey % 301 = 5").select(F.col("p_name").alias("name")).distinct()
    return entity.part_of_written(_spelt(p.where("p_partkey % 17 = 0 OR p_partkey % 40 = 3")), written)
