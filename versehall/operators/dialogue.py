"""Who speaks, judged by words: bags, profiles, likelihoods, links and findings.

All grouped counts and equi-joins; a speaker or word that holds a third of all rows is summed
before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versehall.batches import explode
from versehall.operators.graph import components
from versehall.staging import stage

WORD = r"[\p{L}]+"


def bags(lines: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, word, n) of the words of each line."""
    words = lines.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy(*keys, "word").agg(F.count("*").alias("n"))


def cue_doubt(lines: DataFrame, line: Sequence[str], speaker: str, text: str, smooth: float = 0.5, margin: float = 1.0) -> DataFrame:
    """Lines likelier by `margin` nats under another speaker's words, their own line left
    out of their speaker's profile; ties to the smaller name.

    log P(bag | speaker) = sum n * log((profile + smooth) / (size + smooth * vocabulary)). Words that
    a speaker never says cost the same rate everywhere, so only words in the profile are joined."""
    own = bags(lines, [*line, speaker], text)
    profile = own.groupBy(speaker, "word").agg(F.sum("n").alias("c"))
    total = profile.groupBy(speaker).agg(F.sum("c").alias("size"))
    vocabulary = profile.agg(F.count_distinct("word").alias("v"))  # one row
    said = own.groupBy(*line, speaker).agg(F.sum("n").alias("m"))
    other = profile.select(F.col(speaker).alias("by"), "word", "c")
    hits = own.join(other, "word").groupBy(*line, speaker, "by")
    hits = hits.agg(F.sum(F.col("n") * F.log(F.greatest(F.col("c") - F.when(F.col(speaker) == F.col("by"), F.col("n")).otherwise(0), F.lit(0)) + smooth)).alias("seen"), F.sum("n").alias("k"))
    sizes = total.select(F.col(speaker).alias("by"), "size")
    full = hits.join(said, [*line, speaker]).join(sizes, "by").crossJoin(vocabulary)
    size = F.col("size") - F.when(F.col(speaker) == F.col("by"), F.col("m")).otherwise(0)
    score = F.col("seen") + (F.col("m") - F.col("k")) * F.log(F.lit(smooth)) - F.col("m") * F.log(size + smooth * F.col("v"))
    full = full.withColumn("score", score)
    mine = full.where(F.col(speaker) == F.col("by")).select(*line, F.col("score").alias("mine"))
    best = full.where(F.col(speaker) != F.col("by")).groupBy(*line, speaker).agg(F.max_by(F.struct("by", "score"), F.struct("score")).alias("b"))
    out = best.join(mine, list(line)).withColumn("margin", F.col("b.score") - F.col("mine"))
    return out.where(F.col("margin") >= margin).select(*line, speaker, F.col("b.by").alias("likelier"), "margin")


def epithets(docs: DataFrame, key: str, text: str, titles: Sequence[str]) -> DataFrame:
    """How often a title stands right before a name, and in how many documents."""
    pair = rf"(?:^|[^\p{{L}}])({'|'.join(titles)}) (\p{{Lu}}\p{{L}}+)"
    t = F.regexp_extract_all(text, F.lit(pair), F.lit(1))
    n = F.regexp_extract_all(text, F.lit(pair), F.lit(2))
    rows = docs.select(key, F.explode(F.arrays_zip(t.alias("title"), n.alias("name"))).alias("x")).select(key, "x.title", "x.name")
    return rows.groupBy("title", "name").agg(F.count("*").alias("n"), F.count_distinct(key).alias("docs"))


def narrator(lines: DataFrame, book: str, kind: Column, mentions: DataFrame, least: float = 3.0) -> DataFrame:
    """The name mentioned in dialogue at least `least` times as often as in narration (both
    plus one); `mentions` holds (book, line kind, name)."""
    c = mentions.groupBy(book, "name").agg(F.count_if(kind == "dialogue").alias("d"), F.count_if(kind == "narration").alias("n"))
    ratio = c.withColumn("ratio", (F.col("d") + 1) / (F.col("n") + 1)).where(F.col("ratio") >= least)
    return ratio.groupBy(book).agg(F.max_by(F.struct("name", "ratio"), F.struct("ratio", "d", "name")).alias("x")).select(book, "x.name", "x.ratio")


def blockers(rows: DataFrame, key: str, codes: str, allowed: Sequence[str], accepted: DataFrame | None = None) -> DataFrame:
    """Rows whose `|`-separated codes hold some that are neither allowed nor accepted by key."""
    left = F.array_except(F.split(codes, r"\|"), F.array(*[F.lit(a) for a in allowed], F.lit("")))
    out = rows.withColumn("blocking", left).where(F.size("blocking") > 0)
    return out if accepted is None else out.join(accepted.select(key).distinct(), key, "left_anti")


def work_items(findings: Sequence[DataFrame], severity: dict[str, float], line: str) -> DataFrame:
    """Findings (line, kind, affected, doubt) in order of rules, one a line (the first rule
    that asks), by score = round(affected * doubt * severity, 3), ties in order of rules and lines."""
    every = None
    for place, found in enumerate(findings):
        part = found.select(line, "kind", "affected", "doubt", F.lit(place).alias("rule"))
        every = part if every is None else every.unionByName(part)
    first = F.row_number().over(Window.partitionBy(line).orderBy("rule", "kind"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in severity.items() for x in kv]), F.col("kind"))
    once = every.withColumn("r", first).where("r = 1")
    return once.select(line, "kind", "rule", F.round(F.col("affected") * F.col("doubt") * weight, 3).alias("score"))


def context_budget(lines: DataFrame, by: str, seq: str, size: Column, budget: int) -> DataFrame:
    """For each line the first and last line whose words, taken evenly before and after, stay
    within half the budget each: range frames over the running sum of sizes (sizes are not negative)."""
    upto = F.sum(size).over(Window.partitionBy(by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.select(by, seq, size.alias("__w"), upto.cast("long").alias("__end"))
    half = budget // 2
    before = Window.partitionBy(by).orderBy(F.col("__end") - F.col("__w")).rangeBetween(-half, 0)
    after = Window.partitionBy(by).orderBy("__end").rangeBetween(0, half)
    return rows.select(by, seq, F.min(seq).over(before).alias("first"), F.max(seq).over(after).alias("last"))


def temperature(scores: DataFrame, item: str, logit: str, right: Column, grid: Sequence[float]) -> DataFrame:
    """M6: the temperature of the grid with the least negative log likelihood of the right labels."""
    t = scores.select(item, F.col(logit).alias("z"), right.alias("y"), F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("t"))
    each = t.groupBy(item, "t").agg((F.log(F.sum(F.exp(F.col("z") / F.col("t")))) - F.max(F.when(F.col("y"), F.col("z") / F.col("t")))).alias("nll"))
    total = each.groupBy("t").agg(F.sum("nll").alias("nll"))
    return total.agg(F.min_by(F.struct("t", "nll"), F.struct("nll", "t")).alias("x")).select("x.t", "x.nll")


def point_of_view(chapters: DataFrame, heading: str, text: str, first_person: str, rate: float = 0.3, told: int = 2) -> DataFrame:
    """Chapters headed by the name of who tells them: at least `rate` of their sentences in the
    first person, the name itself at most `told` times in the text."""
    sentences = F.filter(F.split(text, r"[.!?…]+"), lambda s: F.trim(s) != "")
    share = F.size(F.filter(sentences, lambda s: s.rlike(first_person))) / F.greatest(F.lit(1), F.size(sentences))
    about = (F.length(text) - F.length(F.replace(F.col(text), F.col(heading), F.lit("")))) / F.greatest(F.lit(1), F.length(heading))
    out = chapters.withColumn("first_person_rate", share).withColumn("told_about", F.when(F.length(heading) > 0, about).cast("int"))
    return out.where((F.col("first_person_rate") >= rate) & (F.col("told_about") <= told))


def split_labels(terms: DataFrame, label: str, line: str, term: str) -> DataFrame:
    """Labels whose lines fall into groups that share no term: (label, groups, largest). Groups are the
    connected components of a label's terms, joined where a line has both."""
    own = terms.select(label, line, F.col(term).alias("t")).where(F.col("t").isNotNull()).distinct()
    first = own.groupBy(label, line).agg(F.min("t").alias("first"))
    end = lambda t: F.struct(F.col(label).alias("l"), F.col(t).alias("t"))
    of = components(own.join(first, [label, line]).select(end("t").alias("a"), end("first").alias("b")).distinct())
    of = of.select(F.col("node.l").alias(label), F.col("node.t").alias("first"), "component")
    sizes = first.join(of, [label, "first"]).groupBy(label, "component").agg(F.count("*").alias("lines"))
    found = sizes.groupBy(label).agg(F.count("*").cast("int").alias("groups"), F.max("lines").cast("int").alias("largest"))
    return found.where("groups > 1")


def _voices(label, chapter, edges: Sequence[dict]) -> Iterator[tuple]:
    """(label, chapter, term, voice): the least term that can be reached over a chapter's edges."""
    root: dict = {}

    def find(t):
        while root.setdefault(t, t) != t:
            root[t] = t = root[root[t]]
        return t

    for e in edges:
        a, b = find(e["t"]), find(e["first"])
        root[max(a, b)] = min(a, b)
    return ((label, chapter, t, find(t)) for t in list(root))


def split_doubts(terms: DataFrame, label: str, chapter: str, line: str, term: str, selves: Sequence[str], vocabulary: int, least_lines: int = 2, least_known: int = 8, margin: float = 0.5) -> DataFrame:
    """Chapters in which a label seems to stand for two people: (label, chapter, odd lines, odd
    terms, usual terms, margin). Rows are the terms of address of each line.

    Terms said in one line belong together, and so do those joined over other lines: the voices of a
    label's chapter are the connected components of its terms; a chapter's distinct terms must fit a task. The two
    voices with most lines (at least `least_lines`; ties to the one whose first line comes first) must either have different terms for the
    speaker's self (`selves`) or two terms each. Which is the odd one is told by the label's terms in its
    other chapters (at least `least_known`): its log likelihood a term is lower by `margin`. Only the
    lines of chapters found are gathered."""
    keys, kinds = [label, chapter], dict(terms.dtypes)
    own = terms.select(*keys, line, F.col(term).alias("t")).where(F.col("t").isNotNull())
    own = stage(own.groupBy(*keys, line, "t").agg(F.count("*").alias("n")), "terms-of-lines")
    first = own.groupBy(*keys, line).agg(F.min("t").alias("first"))
    edges = own.join(first, [*keys, line]).groupBy(*keys).agg(F.collect_set(F.struct("t", "first")).alias("edges"))
    of = stage(explode(edges, _voices, f"`{label}` {kinds[label]}, `{chapter}` {kinds[chapter]}, t {kinds[term]}, voice {kinds[term]}"), "voices")

    every_bag = stage(own.groupBy(*keys, "t").agg(F.sum("n").alias("n")), "terms-of-chapters")
    bags = every_bag.join(of, [*keys, "t"])
    in_lines = first.join(of.withColumnRenamed("t", "first"), [*keys, "first"])
    lines = in_lines.groupBy(*keys, "voice").agg(F.count("*").alias("lines"), F.min(line).alias("begins"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("lines").desc(), "begins"))
    two = lines.where(F.col("lines") >= least_lines).withColumn("place", place).where("place <= 2").select(*keys, "voice", "place")
    told = bags.join(two, [*keys, "voice"])
    mine = F.array_sort(F.collect_set(F.when(F.col("t").isin(*selves), F.col("t"))))
    sides = told.groupBy(*keys, "voice", "place").agg(F.count("*").alias("kinds"), mine.alias("selves"))
    pair = sides.groupBy(*keys).agg(F.count("*").alias("sides"), F.min("kinds").alias("kinds"), F.max_by("selves", "place").alias("x"), F.min_by("selves", "place").alias("y"))
    differ = (F.size("x") > 0) & (F.size("y") > 0) & ~F.arrays_overlap("x", "y")
    pair = pair.where((F.col("sides") == 2) & (differ | (F.col("kinds") >= 2))).select(*keys)

    every = every_bag.groupBy(label, "t").agg(F.sum("n").alias("all"))
    size = every_bag.groupBy(*keys).agg(F.sum("n").alias("own_size")).join(every_bag.groupBy(label).agg(F.sum("n").alias("size")), label)
    rows = told.join(pair, keys).join(every, [label, "t"]).join(size, keys)
    known = F.col("size") - F.col("own_size")
    fit = F.sum(F.col("n") * F.log((F.col("all") - F.col("n") + 0.5) / (known + 0.5 * vocabulary))) / F.sum("n")
    fits = rows.where(known >= least_known).groupBy(*keys, "voice", "place").agg(fit.alias("fit"), F.sort_array(F.collect_list("t")).alias("terms"))
    side = F.struct("fit", "place", "voice", "terms")
    both = fits.groupBy(*keys).agg(F.min(side).alias("odd"), F.max(side).alias("usual"))
    apart = F.col("usual.fit") - F.col("odd.fit")
    found = both.where((apart >= margin) & (F.col("usual.place") != F.col("odd.place")))
    found = found.select(*keys, F.col("odd.voice").alias("voice"), F.col("odd.terms").alias("odd"), F.col("usual.terms").alias("usual"), apart.alias("margin"))
    gathered = in_lines.join(found.select(*keys, "voice"), [*keys, "voice"]).groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return found.join(gathered, keys).select(*keys, "lines", "odd", "usual", "margin")
