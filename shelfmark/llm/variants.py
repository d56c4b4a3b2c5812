"""Variant spellings of the names of people and bodies, linked by a pigeonhole segment join.

A name is brought to its visible form and parsed: surname, given names, years
of life, or the bag of words of a body. The parts take these variants to one
key without comparing names: order (``Surname, Given`` or ``Given Surname``),
case, accents, titles, marks of doubt on years, expanded initials,
abbreviations of bodies. Where a name has no comma, both orders are kept until
the rest of the collection shows which one other names have.

Typing errors are found by a segment join: with at most ``K`` edits, one of
``K + 1`` segments of a string occurs unchanged in the other, shifted by at
most ``K`` places. Segments are looked up in an inverted index and verified by a
banded edit distance. Whole names (surname and given name together) of one
life, that is of the same years of birth and death, may differ in ``K`` letters.
Without such evidence the parts of names are joined, each under the part that must agree (the given name for surnames, the surname
for given names), and may differ in one error, where a swap of neighbours and a
pair of letters read as one count as one.

Whether a name is a body is read from connecting words, from the words of
``BODY_WORDS`` and from words that the collection shows to be of bodies: those
in at least ``BODY_SHARE`` of the names with a connecting word, beside
``BODY_RESTS`` different other words or more, and in no name with years.

Names without years, with initials or a pet name join the one person they fit;
where they fit several people (namesakes with other years, relatives), they
join none of them. Different years of birth are different people.

Nothing compares all names of a group: every step is an equi-join or an
aggregation on keys. Only the pairs of one entity, which are the result, are
listed.

Defined results: null and blank names give nothing; repeated names count once;
two names of the same visible form are linked; an unreadable name is linked
only to names of its own visible form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.visual import transducer
from shelfmark.session import cut, width

K = 2
#: Given names and surnames that occur with this many partners are taken as real, not as slips of others.
REAL = 3
#: ... unless one of two similar ones is so many times as frequent as the other: then the rare one is a slip of it.
GIVEN_RATIO, SUR_RATIO = 20, 6

#: Pet names and the names they stand for (fixed values).
PET_NAMES = """abby abigail; alec alexander; alex alexander alexandra; andy andrew; annie anna anne; archie archibald; art arthur;
barney barnabas; becky rebecca; bella isabel isabella; ben benjamin; bert albert herbert; bertie albert herbert bertha; bess elizabeth elisabeth;
bessie elizabeth elisabeth; beth elizabeth elisabeth; betsy elizabeth elisabeth; betty elizabeth elisabeth; bill william; billy william;
bob robert; bobby robert; cathy catherine; charley charles; charlie charles; chris christopher christina; dan daniel; danny daniel; dave david;
dick richard; dolly dorothea dorothy; dora dorothea theodora; dot dorothea dorothy; ed edward edmund edgar edwin; eddie edward edmund edgar edwin;
effie euphemia; ella eleanor; ellie eleanor; elsie elisabeth elizabeth; fanny frances; flo florence; florrie florence; flossie florence;
frank francis; frankie frances francis; fred frederick alfred; freddie frederick; gerry gerald; gertie gertrude; gil gilbert; ginny virginia;
gus augustus; hal henry harold; hank henry; harry henry harold; hattie harriet; hetty harriet henrietta; jack john; jake jacob; jamie james;
jem james; jenny jane jennifer; jerry gerald jeremiah; jim james; jimmy james; jo josephine joseph; joe joseph; johnny john; josie josephine;
kate katharine catherine katherine; katie katharine catherine katherine; kathy katharine catherine katherine; kit christopher catherine;
kitty catherine katharine katherine; larry laurence lawrence; len leonard; lenny leonard; leo leonard leopold; lettie lettice; libby elizabeth elisabeth;
lisa elizabeth elisabeth; liz elizabeth elisabeth; liza elizabeth elisabeth; lizzie elizabeth elisabeth; lottie charlotte; lou louis louisa;
madge margaret; maggie margaret; mamie mary; marty martin martha; mattie matilda martha; maud matilda; meg margaret; mick michael; mike michael;
millie mildred millicent; mina wilhelmina; minnie wilhelmina; moll mary; molly mary; nan anna anne; nancy anna anne; nat nathaniel; nate nathaniel;
ned edward edmund edgar; nell eleanor helen helena; nellie eleanor helen helena; nick nicholas; nora eleanor honora; ozzie oscar; pat patricia patrick;
patsy patricia; patty patricia martha; paula pauline; peg margaret; peggy margaret; percy percival; pete peter; phil philip philippa; pip philip;
pippa philippa; polly mary; ray raymond; rick richard; rob robert; robin robert; ronnie ronald; rose rosalind; rosie rosalind rose; rudi rudolf;
rudy rudolf; sadie sarah; sally sarah; sam samuel samantha; sandy alexander; sue susanna susan; sukey susanna susan; susie susanna susan; ted edward theodore edmund;
teddy edward theodore; tess theresa; theo theodore; tilda matilda; tillie matilda; tim timothy; toby tobias; tom thomas; tommy thomas; tony anthony anton;
trudy gertrude; ursie ursula; vic victor victoria; viv vivian; wally walter; walt walter; will william; willie william; winnie winifred; wilma wilhelmina"""
PETS = {x.split()[0]: x.split()[1:] for x in PET_NAMES.replace("\n", " ").split(";")}
#: Share of the names with a connecting word that hold a word of bodies, and how many different rests these have; at most
#: (words of a name) / BODY_SHARE words can reach the share, so they are few at any size.
BODY_SHARE, BODY_RESTS = 0.005, 3
#: Whole names of so many letters may differ in K letters.
LONG_NAME = 12
#: Names that no other name explains are compared as bags of so many words, in words of so many letters.
BAG_WORDS, BAG_LETTERS = 3, 7

#: Connecting words, words of bodies, their short forms, and words that say nothing about which body it is (fixed values).
CONNECT = {"of", "for", "the", "and"}
BODY_WORDS = {"press", "society", "institute", "university", "sons", "company", "brothers", "college", "academy", "association", "club", "museum", "library"}
SHORT = {"univ": "university", "inst": "institute", "soc": "society", "co": "company", "bros": "brothers", "assoc": "association", "acad": "academy", "coll": "college", "mus": "museum", "lib": "library"}
SILENT = {"the", "of", "for", "f", "and", "messrs", "firm", "ltd", "limited", "inc", "fuer", "in", "at"}
TITLES = {"dr", "sir", "prof", "professor", "rev", "mr", "mrs", "miss", "lady", "lord", "mme", "st", "saint", "dame", "baron", "baroness", "count", "capt"}

_YEARS = re.compile(r"\(?\b(\d{4})\s*\??\s*[-–—]\s*(\d{4})?\s*\??\)?")
_BORN = re.compile(r"\(?\b(?:b|born)\.?\s*(\d{4})\s*\??\)?", re.I)
_DIED = re.compile(r"\(?\b(?:d|died)\.?\s*(\d{4})\s*\??\)?", re.I)
_UP = re.compile(r"\bu\.\s?p\.?(?=\W|$)")
_LETTER_RUN = re.compile(r"[^\W\d_]+")
_MISREAD = str.maketrans({"1": "l", "0": "o", "5": "s"})
_MARKED_BASE = {"ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "ß": "ss", "ð": "d", "þ": "th"}


def plain(s: str) -> str:
    """Small letters without accents; digits inside words as the letters they are misread for."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))
    s = "".join(_MARKED_BASE.get(c, c) for c in s)
    return re.sub(r"(?<=[^\W\d_])[105](?=[^\W\d_]|\b)|\b[105](?=[^\W\d_]{2})", lambda m: m[0].translate(_MISREAD), s)


def name_words(form: str) -> list[str]:
    """The words of a name without its years, short forms of bodies written out."""
    s = plain(form).replace("&", " and ")
    for p in (_YEARS, _BORN, _DIED):
        s = p.sub(" ", s)
    return [SHORT.get(w, w) for w in _LETTER_RUN.findall(_UP.sub(" university press ", s))]


def parse(form: str, learned: frozenset = frozenset()) -> list[tuple]:
    """Readings of a name: ``(kind, sur, g1, g2, birth, death)``; kinds are person, initial and body. ``learned`` are words of bodies."""
    s = plain(form)
    birth = death = 0
    if m := _YEARS.search(s):
        birth, death = int(m[1]), int(m[2] or 0)
        s = s[: m.start()] + s[m.end() :]
    elif m := _BORN.search(s):
        birth = int(m[1])
        s = s[: m.start()] + s[m.end() :]
    elif m := _DIED.search(s):
        death = int(m[1])
        s = s[: m.start()] + s[m.end() :]
    words = [SHORT.get(w, w) for w in _LETTER_RUN.findall(_UP.sub(" university press ", s.replace("&", " and ")))]
    if not birth and not death and len(words) > 1 and (BODY_WORDS | CONNECT | learned) & set(words):
        bag = sorted(w for w in words if w not in SILENT)
        return [("body", bag[k], " ".join(bag[:k] + bag[k + 1 :]), "", 0, 0) for k in range(len(bag))]
    full = ""
    if m := re.search(r"\(([^()]+)\)", s):
        full = m[1]
        s = s[: m.start()] + s[m.end() :]
    parts = [p for p in (" ".join(w for w in _LETTER_RUN.findall(p) if w not in TITLES) for p in s.split(",")) if p]
    if not parts:
        return []
    orders = []
    if len(parts) > 1:
        orders.append((parts[0], parts[1].split()))
    else:
        w = parts[0].split()
        if len(w) == 1:
            return [("person", w[0], "", "", birth, death)]
        if len(w[-1]) > 1:
            orders.append((w[-1], w[:-1]))
        if len(w[0]) > 1:
            orders.append((w[0], w[1:]))
    out = []
    for sur, given in orders:
        expanded = full.split()
        if expanded and given and expanded[0][:1] == given[0][:1]:
            given = expanded
        g1, g2 = given[0], given[1] if len(given) > 1 else ""
        out.append(("initial" if len(g1) == 1 else "person", sur, g1, g2, birth, death))
    return out


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of each name: the other words, whether a connecting word is among them, whether the name has years. A row without a word stands for a name with a connecting word."""
    visible = transducer()
    for b in batches:
        rows = []
        for name in b.column(0).to_pylist():
            form = visible(name)
            words = set(name_words(form))
            if dated := bool(_YEARS.search(form) or _BORN.search(form) or _DIED.search(form)):
                words = {w for w in words if len(w) > 1}
            connected = bool(words & CONNECT) and not dated
            if connected:
                rows.append(("", "", True, False))
            rows += [(w, " ".join(sorted(words - {w} - SILENT)) if connected else "", connected, dated) for w in words - SILENT]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.bool_(), pa.bool_()))], names=["word", "rest", "connected", "dated"])


def body_words(names: DataFrame) -> frozenset:
    """The words that the collection shows to be of bodies; few at any size (see ``BODY_SHARE``)."""
    rows = names.mapInArrow(_word_rows, "word string, rest string, connected boolean, dated boolean")
    each = rows.groupBy("word", "rest", "connected").agg(F.count(F.lit(1)).alias("n"), F.bool_or("dated").alias("dated"))
    stats = cut(each.groupBy("word").agg(F.sum(F.when(F.col("connected"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.col("connected").cast("int")).alias("rests"), F.bool_or("dated").alias("dated")))
    total = stats.filter("word = ''").first()
    if total is None:
        return frozenset()
    found = stats.filter((F.col("word") != "") & ~F.col("dated") & (F.col("rests") >= BODY_RESTS) & (F.col("n") >= BODY_SHARE * total["n"]))
    return frozenset(r.word for r in found.select("word").collect())


RECORD = "name string, form string, bag string, hyp int, n_hyp int, kind string, sur string, g1 string, g2 string, birth int, death int"


def _records(learned: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visible = transducer()
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.int32(), pa.int32()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                form = visible(name)
                got = parse(form, learned) or [("none", form, "", "", 0, 0)]
                bag = " ".join(sorted(name_words(form))) if len(got) > 1 and got[0][0] != "body" else ""
                rows += [(name, form, bag, k, len(got), *g) for k, g in enumerate(got)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def edits(length: int) -> int:
    """With how many edits strings of a length are looked up: ``K``, but no segment is ever empty."""
    return min(K, length - 1)


def segments(s: str) -> list[tuple[int, int, str]]:
    """The segments of a string, one more than edits: number, place, characters; the last ones take what is left over."""
    n, out, at = len(s), [], 0
    k = edits(n)
    for i in range(k + 1):
        size = n // (k + 1) + (i >= k + 1 - n % (k + 1))
        out.append((i, at, s[at : at + size]))
        at += size
    return out


def lookups(s: str) -> set[tuple[int, int, str]]:
    """Keys (length, segment number, characters) under which strings of at most the own length and their number of edits stand.

    Of ``k`` edits at most ``i`` lie before segment ``i`` or else an earlier segment occurs unchanged, and likewise behind
    it: that bounds its shift from both sides, so about a dozen substrings of a string are looked up for ``k = 2``.
    """
    out = set()
    for length in range(max(1, len(s) - K), len(s) + 1):
        at, k, more = 0, edits(length), len(s) - length
        if more > k:
            continue
        for i in range(k + 1):
            size = length // (k + 1) + (i >= k + 1 - length % (k + 1))
            low, high = max(0, at - i, at + more - (k - i)), min(len(s) - size, at + i, at + more + (k - i))
            for p in range(low, high + 1):
                out.add((length, i, s[p : p + size]))
            at += size
    return out


def one_error(a: str, b: str) -> bool:
    """Whether one letter is changed, added, missing or swapped with its neighbour, or two letters are read as one."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    if x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:]):
        return True
    for two, one in (("rn", "m"), ("in", "m"), ("ni", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h")):
        for p, q in ((a, b), (b, a)):
            for j in (i - 1, i):
                if j >= 0 and p[j : j + 2] == two and q[j : j + 1] == one and p[:j] == q[:j] and p[j + 2 :] == q[j + 1 :]:
                    return True
    return False


def _keys(of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, o, f"{length}|{i}|{seg}") for s, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for length, i, seg in of(s)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["s", "o", "seg"])

    return run


def similar(rows: DataFrame) -> DataFrame:
    """Pairs ``x``, ``y`` of strings ``s`` with one error between them and the same ``o``, in both orders: the segment join.

    Whole names, whose ``o`` begins with ``w|``, have ``K`` edits between them; those of one error come out as pairs of parts.
    ``rows`` has distinct ``s, o``; an index of segments is joined with shifted substrings of strings of the same or greater length.
    """
    shape = "s string, o string, seg string"
    rows = rows.select("s", "o").repartition(width(rows.sparkSession))
    index = rows.mapInArrow(_keys(lambda s: {(len(s), i, seg) for i, _, seg in segments(s)}), shape)
    probe = rows.mapInArrow(_keys(lookups), shape)
    pairs = probe.select(F.col("s").alias("x"), "o", "seg").join(index.select(F.col("s").alias("y"), "o", "seg"), ["o", "seg"])
    # strings of one length look each other up: one direction is enough
    once = (F.length("x") > F.length("y")) | (F.col("x") < F.col("y"))
    far = F.levenshtein("x", "y", K)
    near = pairs.filter(once & (far >= 0) & (~F.col("o").startswith("w|") | (F.length("y") >= LONG_NAME))).select("o", "x", "y").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array([one_error(x, y) != o.startswith("w|") for o, x, y in zip(*(c.to_pylist() for c in b.columns))], pa.bool_()))
            yield b
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1)], names=["o", "x", "y"])

    return near.mapInArrow(verify, "o string, x string, y string")


def _corrections(nodes: DataFrame, births: DataFrame, near: DataFrame) -> DataFrame:
    """For a key ``(sur, g1)`` that is a slip or a pet form of another key, that key: ``sur, g1, to_sur, to_g1``.

    ``nodes`` has ``sur, g1, n`` (spellings that surely read so; 0 for possible readings only), whether one is ``dated``,
    and how many partners the parts have, ``sur_real`` and ``g1_real``; ``births`` has the sure ``sur, g1, birth``;
    ``near`` has the similar strings: surnames under ``s|`` and the given name, given names under ``g|`` and the surname,
    whole names (with a comma) under ``w|`` and the years of life, which are evidence enough.
    """
    other = F.substring("o", 3, 1 << 30)
    a = near.filter("o LIKE 's|%'").select(F.col("x").alias("sur"), other.alias("g1"), F.col("y").alias("to_sur"), other.alias("to_g1"), F.lit("sur").alias("part"))
    b = near.filter("o LIKE 'g|%'").select(other.alias("sur"), F.col("x").alias("g1"), other.alias("to_sur"), F.col("y").alias("to_g1"), F.lit("g1").alias("part"))
    pets = nodes.sparkSession.createDataFrame([(p, f) for p, fs in PETS.items() for f in fs], "g1 string, to_g1 string")
    c = nodes.join(F.broadcast(pets), "g1").select("sur", "g1", F.col("sur").alias("to_sur"), "to_g1", F.lit("pet").alias("part"))
    whole = near.filter("o LIKE 'w|%'").select(F.split("x", ",").alias("x"), F.split("y", ",").alias("y"))
    w = whole.select(F.col("x")[0].alias("sur"), F.col("x")[1].alias("g1"), F.col("y")[0].alias("to_sur"), F.col("y")[1].alias("to_g1"), F.lit("whole").alias("part"))
    pair = ["sur", "g1", "to_sur", "to_g1"]
    to = nodes.filter("n > 0").select(*[F.col(x).alias(f"to_{x}") for x in nodes.columns])
    links = cut(a.unionByName(b).unionByName(c).unionByName(w.distinct()).join(to, ["to_sur", "to_g1"]).join(nodes, ["sur", "g1"]))
    to_births = births.select(F.col("sur").alias("to_sur"), F.col("g1").alias("to_g1"), "birth")
    common = links.filter("dated AND to_dated").select(*pair).join(births, ["sur", "g1"]).join(to_births, ["to_sur", "to_g1", "birth"]).select(*pair).distinct()
    links = links.join(common.withColumn("common", F.lit(True)), pair, "left").fillna(False, ["common"]).withColumn("common", F.col("common") | (F.col("part") == "whole"))
    # both are real where both are well attested and neither is rare beside the other
    both = lambda a, b, ratio: (F.col(a) >= REAL) & (F.col(b) >= REAL) & (F.greatest(a, b) < ratio * F.least(a, b))
    real = F.when(F.col("part") == "sur", both("sur_real", "to_sur_real", SUR_RATIO)).when(F.col("part") == "g1", both("g1_real", "to_g1_real", GIVEN_RATIO)).otherwise(F.lit(False))
    # the target must be the better attested of the two: a real name before a slip, then years, then the number of spellings
    by_sur = (F.col("part") == "sur") | ((F.col("part") == "whole") & (F.col("sur") != F.col("to_sur")))
    rank = F.struct(F.when(by_sur, F.col("sur_real")).otherwise(F.col("g1_real")), F.col("dated"), F.col("n"), F.col("sur"), F.col("g1"))
    to_rank = F.struct(F.when(by_sur, F.col("to_sur_real")).otherwise(F.col("to_g1_real")), F.col("to_dated"), F.col("to_n"), F.col("to_sur"), F.col("to_g1"))
    ok = F.when(F.col("part") == "pet", ~F.col("dated") | ~F.col("to_dated") | F.col("common")).otherwise(
        (to_rank > rank) & (F.col("common") | (~real & ~(F.col("dated") & F.col("to_dated")))))
    links = links.filter(ok)
    best = F.struct(F.col("common"), F.col("to_dated"), F.col("to_n"), F.col("to_sur"), F.col("to_g1"))
    # a pet name that fits two people of the surname, or a slip equally near to two keys without common years, joins neither
    picked = links.groupBy("sur", "g1").agg(F.max(best).alias("b"), F.count_distinct("to_sur", "to_g1").alias("c"), F.bool_or("common").alias("sure"))
    return picked.filter("sure OR c = 1").select("sur", "g1", "b.to_sur", "b.to_g1")


def _fits(a: F.Column, b: F.Column) -> F.Column:
    """Whether second given names can be one: equal, missing, or an initial of the other."""
    return (a == "") | (b == "") | (a == b) | ((F.length(a) == 1) & b.startswith(a)) | ((F.length(b) == 1) & a.startswith(b))


def _attach(loose: DataFrame, fixed: DataFrame, on: list[str]) -> DataFrame:
    """``loose`` (keys ``on`` and ``g2``) with the one entity of ``fixed`` (``on, g2, entity``) that it fits, or null."""
    f = fixed.select(*on, F.col("g2").alias("of_g2"), "entity")
    fit = loose.join(f, on).filter(_fits(F.col("g2"), F.col("of_g2")))
    one = fit.groupBy(*on, "g2").agg(F.min("entity").alias("entity"), F.max("entity").alias("last"))
    one = one.withColumn("entity", F.when(F.col("entity") == F.col("last"), F.col("entity"))).drop("last")
    return loose.join(one, [*on, "g2"], "left")


def _second_names(chosen: DataFrame, givens: DataFrame) -> DataFrame:
    """``chosen`` with the slips in second given names of people put right; ``own_g2`` is the second name as spelled.

    Judged under the corrected surname and first name, by the rules of first names; ``givens`` has how many surnames a first name has.
    """
    key = F.concat_ws("|", "sur", "g1")
    full = chosen.filter("kind = 'person' AND length(g2) > 1").groupBy(key.alias("o"), "g2").agg(
        F.count_distinct("form").alias("n"), F.bool_or(F.col("birth") > 0).alias("dated"), F.collect_set(F.when(F.col("birth") > 0, F.col("birth"))).alias("births"))
    full = cut(full)
    # names that nothing explains, as bags of words, go into the same segment join
    loose = cut(chosen.filter(f"score = 0 AND bag != '' AND size(split(bag, ' ')) >= {BAG_WORDS}").groupBy("bag").agg(
        F.count_distinct("form").alias("n"), F.min(F.struct("form", "sur", "g1", "g2")).alias("as")))
    own = F.explode(F.split("bag", " ")).alias("s")
    rest = F.array_join(F.array_remove(F.split("bag", " "), F.col("s")), " ")
    bag_words = loose.select("bag", own).filter(F.length("s") >= BAG_LETTERS).withColumn("o", F.concat(F.lit("u|"), rest)).distinct()
    near = cut(similar(full.select(F.col("g2").alias("s"), F.concat(F.lit("n|"), "o").alias("o")).unionByName(bag_words.select("s", "o")).distinct()))
    bag_slips = near.filter("o LIKE 'u|%'").join(bag_words.withColumnRenamed("s", "x"), ["x", "o"]).join(bag_words.select(F.col("s").alias("y"), "o", F.col("bag").alias("to_bag")), ["y", "o"])
    numbers = loose.select("bag", "n")
    bag_slips = bag_slips.join(numbers, "bag").join(numbers.select(F.col("bag").alias("to_bag"), F.col("n").alias("to_n")), "to_bag")
    bag_slips = bag_slips.filter(F.struct("to_n", "to_bag") > F.struct("n", "bag")).groupBy("bag").agg(F.max_by("to_bag", F.struct("to_n", "to_bag")).alias("to_bag"))
    reading = loose.select(F.col("bag").alias("to_bag"), "as")
    moved = cut(loose.select("bag").join(bag_slips, "bag", "left").withColumn("to_bag", F.coalesce("to_bag", "bag")).join(reading, "to_bag").select("bag", F.col("as.sur").alias("as_sur"), F.col("as.g1").alias("as_g1"), F.col("as.g2").alias("as_g2"), F.lit(0).alias("score")))
    near = near.filter("o LIKE 'n|%'").withColumn("o", F.substring("o", 3, 1 << 30))
    near = near.select("o", F.col("x").alias("g2"), F.col("y").alias("to_g2"))
    real = full.groupBy("g2").agg(F.count(F.lit(1)).alias("k")).join(givens.withColumnRenamed("g1", "g2"), "g2", "left").select("g2", (F.col("k") + F.coalesce("g1_real", F.lit(0))).alias("real"))
    nodes = full.join(real, "g2")
    links = near.join(nodes, ["o", "g2"]).join(nodes.select("o", *[F.col(x).alias(f"to_{x}") for x in nodes.columns if x != "o"]), ["o", "to_g2"])
    common = F.arrays_overlap("births", "to_births")
    both = (F.least("real", "to_real") >= REAL) & (F.greatest("real", "to_real") < GIVEN_RATIO * F.least("real", "to_real"))
    rank = [F.struct(*[F.col(p + x) for x in ("real", "dated", "n", "g2")]) for p in ("", "to_")]
    links = links.withColumn("common", common).filter((rank[1] > rank[0]) & (common | (~both & ~(F.col("dated") & F.col("to_dated")))))
    picked = links.groupBy("o", "g2").agg(F.max_by("to_g2", F.struct("common", "to_dated", "to_n", "to_g2")).alias("to_g2"), F.count_distinct("to_g2").alias("c"), F.bool_or("common").alias("sure"))
    fix = cut(picked.filter("sure OR c = 1").select("o", "g2", "to_g2"))
    again = fix.select("o", F.col("g2").alias("to_g2"), F.col("to_g2").alias("g22"))
    fix = fix.join(again, ["o", "to_g2"], "left").select("o", "g2", F.coalesce("g22", "to_g2").alias("to_g2"))
    # an initial and a person of one key have keys of their own: the first name of an initial is one letter
    out = chosen.withColumn("o", F.when(F.col("kind") == "person", key)).join(fix, ["o", "g2"], "left")
    out = out.withColumn("own_g2", F.col("g2")).withColumn("g2", F.coalesce("to_g2", "g2")).drop("o", "to_g2").join(moved, ["bag", "score"], "left")
    return out.withColumns({x: F.coalesce(f"as_{x}", x) for x in ("sur", "g1", "g2")}).drop("bag", "score", "as_sur", "as_g1", "as_g2")


def _shown(df: DataFrame, on: list[str]) -> DataFrame:
    """The second given name of each ``on``: a full one before an initial before none, then the one of most spellings."""
    each = df.groupBy(*on, "g2").agg(F.count_distinct("form").alias("n"))
    return each.groupBy(*on).agg(F.max_by("g2", F.struct(F.least(F.length("g2"), F.lit(2)), "n", F.length("g2"), "g2")).alias("g2"))


def entities(names: DataFrame, column: str) -> DataFrame:
    """``name, entity`` of the distinct names."""
    spark = names.sparkSession
    distinct = cut(names.select(F.col(column).alias("name")).filter(F.col("name").isNotNull()).distinct().repartition(width(spark)))
    recs = cut(distinct.mapInArrow(_records(body_words(distinct)), RECORD))

    # people: which readings are sure, and what they show
    people = recs.filter("kind IN ('person', 'initial')")
    sure = people.filter("n_hyp = 1 AND kind = 'person'")
    is_sure = F.col("n_hyp") == 1
    keys = cut(people.filter("kind = 'person'").groupBy("sur", "g1").agg(
        F.count_distinct(F.when(is_sure, F.col("form"))).alias("n"), F.bool_or(is_sure & (F.col("birth") > 0)).alias("dated")))
    surs = cut(keys.filter("n > 0").groupBy("sur").agg(F.count(F.lit(1)).alias("sur_real")))
    givens = keys.filter("n > 0").groupBy("g1").agg(F.count(F.lit(1)).alias("g1_real"))
    nodes = cut(keys.join(surs, "sur", "left").join(givens, "g1", "left").fillna(0, ["sur_real", "g1_real"]).select("sur", "g1", "n", "dated", "sur_real", "g1_real"))
    births = cut(sure.filter("birth > 0").select("sur", "g1", "birth").distinct())
    # one segment join for all: surnames of a given name, given names of a surname, words of a body
    bodies = recs.filter("kind = 'body'").withColumn("bag", F.array_join(F.array_sort(F.split(F.concat_ws(" ", "sur", "g1"), " ")), " "))
    words = cut(bodies.filter(F.length("sur") >= 2).select("sur", "g1", "bag").distinct())
    tag = lambda t, c: F.concat(F.lit(t), c).alias("o")
    rows = nodes.select(F.col("sur").alias("s"), tag("s|", F.col("g1"))).unionByName(nodes.filter("g1 != ''").select(F.col("g1").alias("s"), tag("g|", F.col("sur"))))
    lives = sure.filter("birth > 0 AND death > 0 AND g1 != ''").select(F.concat_ws(",", "sur", "g1").alias("s"), F.concat_ws("|", F.lit("w"), "birth", "death").alias("o")).distinct()
    near = cut(similar(rows.unionByName(lives).unionByName(words.select(F.col("sur").alias("s"), tag("b|", F.col("g1"))))))
    fix = cut(_corrections(nodes, births, near))
    again = fix.select(F.col("sur").alias("to_sur"), F.col("g1").alias("to_g1"), F.col("to_sur").alias("sur2"), F.col("to_g1").alias("g12"))
    fix = fix.join(again, ["to_sur", "to_g1"], "left").select("sur", "g1", F.coalesce("sur2", "to_sur").alias("to_sur"), F.coalesce("g12", "to_g1").alias("to_g1"))
    known = cut(keys.select("sur", "g1", "n").join(fix, ["sur", "g1"], "left"))
    read = people.join(known, ["sur", "g1"], "left").join(surs, "sur", "left").fillna(0, ["n", "sur_real"])
    score = F.when(F.col("n") > 0, 3).when(F.col("to_sur").isNotNull(), 2).when(F.col("sur_real") > 0, 1).otherwise(0)
    order = Window.partitionBy("name").orderBy(score.desc(), "hyp")
    chosen = read.withColumn("r", F.row_number().over(order)).filter("r = 1").select(
        "name", "form", "kind", F.coalesce("to_sur", "sur").alias("sur"), F.coalesce("to_g1", "g1").alias("g1"), "g2", "birth",
        F.col("sur").alias("own_sur"), F.substring("g1", 1, 1).alias("own_i"), "bag", score.alias("score"))
    chosen = cut(_second_names(cut(chosen), givens))

    key = ["sur", "g1"]
    dated = _shown(chosen.filter("kind = 'person' AND birth > 0"), [*key, "birth"])
    dated = dated.withColumn("entity", F.concat_ws("|", F.lit("p"), *key, "birth"))
    loose = chosen.filter("kind = 'person' AND birth = 0").select(*key, "g2").distinct()
    tied = cut(_attach(loose, dated, key))
    free = tied.filter("entity IS NULL").drop("entity")
    # without years: a missing or shortened second name joins the one full form it fits
    longest = free.filter("length(g2) > 1").withColumn("entity", F.concat_ws("|", F.lit("p"), *key, "g2"))
    short = _attach(free.filter("length(g2) <= 1"), longest, key).withColumn("entity", F.coalesce("entity", F.concat_ws("|", F.lit("p"), *key, F.lit(""))))
    undated = cut(tied.filter("entity IS NOT NULL").unionByName(longest).unionByName(short))
    keep = ["name", "form", "entity", "own_sur", "own_i", "g2", "own_g2", "birth"]
    a = chosen.filter("kind = 'person' AND birth > 0").withColumn("entity", F.concat_ws("|", F.lit("p"), *key, "birth")).select(keep)
    b = chosen.filter("kind = 'person' AND birth = 0").join(undated, [*key, "g2"]).select(keep)
    # initials: the one person of the surname (as spelled there) with such given names (and year of birth, if there is one)
    ab = cut(a.unionByName(b))
    spelled = ab.withColumnsRenamed({"own_sur": "sur", "own_i": "g1"})
    one = ["sur", "g1", "entity"]
    shown = _shown(spelled, one).unionByName(spelled.filter("own_g2 != g2").select(*one, F.col("own_g2").alias("g2"))).distinct()
    people_of = cut(shown.join(spelled.groupBy(*one).agg(F.max("birth").alias("birth")), one))
    initials = chosen.filter("kind = 'initial'")
    by_year = initials.filter("birth > 0").select("sur", "g1", "birth", "g2").distinct()
    with_year = _attach(by_year, people_of.filter("birth > 0"), ["sur", "g1", "birth"])
    without = _attach(initials.filter("birth = 0").select("sur", "g1", "g2").distinct(), people_of, ["sur", "g1"]).withColumn("birth", F.lit(0))
    own = F.concat_ws("|", F.lit("i"), "sur", "g1", "g2", "birth")
    c = initials.join(with_year.unionByName(without), ["sur", "g1", "g2", "birth"]).select("name", "form", F.coalesce("entity", own).alias("entity"))
    # bodies: the bag of words is the key; a slip in one word leads to the better attested bag
    counts = cut(bodies.filter("hyp = 0").groupBy("bag").agg(F.count_distinct("form").alias("n")))
    slips = near.filter("o LIKE 'b|%'").select(F.col("x").alias("sur"), F.substring("o", 3, 1 << 30).alias("g1"), "y")
    # a slip in a word of under five letters is one only where the other word is well attested and the own one is not
    forms = cut(bodies.groupBy("sur").agg(F.count_distinct("form").alias("forms")))
    slips = slips.join(forms, "sur").join(forms.select(F.col("sur").alias("y"), F.col("forms").alias("to_forms")), "y").filter(
        (F.least(F.length("sur"), F.length("y")) >= 5) | ((F.col("to_forms") >= REAL) & ((F.col("forms") < REAL) | (F.col("forms") * SUR_RATIO <= F.col("to_forms")))))
    slips = slips.join(words, ["sur", "g1"]).join(words.select(F.col("sur").alias("y"), "g1", F.col("bag").alias("to_bag")), ["y", "g1"])
    slips = slips.join(counts, "bag").join(counts.select(F.col("bag").alias("to_bag"), F.col("n").alias("to_n")), "to_bag")
    slips = slips.filter(F.struct("to_n", "to_bag") > F.struct("n", "bag")).groupBy("bag").agg(F.max_by("to_bag", F.struct("to_n", "to_bag")).alias("to_bag"))
    body = bodies.filter("hyp = 0").join(cut(slips), "bag", "left").select("name", "form", F.concat(F.lit("body|"), F.coalesce("to_bag", "bag")).alias("entity"))
    rest = recs.filter("kind = 'none'").select("name", "form", F.concat(F.lit("n|"), F.col("form")).alias("entity"))
    return body.unionByName(ab.select("name", "form", "entity")).unionByName(c).unionByName(rest).select("name", "entity")


def variant_pairs(names: DataFrame, column: str) -> DataFrame:
    """Pairs of different names of one person or body: ``name_a, name_b``."""
    found = cut(entities(names, column))
    several = found.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = cut(found.join(several, "entity"))
    # the pairs of an entity, which are what is asked for, come from a join of its names with each other
    pairs = members.withColumnRenamed("name", "name_a").join(members.withColumnRenamed("name", "name_b"), "entity")
    return pairs.filter("name_a < name_b").select("name_a", "name_b")
