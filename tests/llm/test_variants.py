import random

from shelfmark.llm.variants import body_words, edits, lookups, one_error, parse, segments, variant_pairs


def test_parse():
    assert parse("Hakofeho, Henry, 1793-1854")[0] == ("person", "hakofeho", "henry", "", 1793, 1854)
    assert parse("Lultåhanar, F. S. (Felix Samuel), 1739?-1818")[0] == ("person", "lultahanar", "felix", "samuel", 1739, 1818)
    assert parse("S.L. Binmintulga") == [("initial", "binmintulga", "s", "l", 0, 0)]
    assert [r[1] for r in parse("Valarbringo Gerald")] == ["gerald", "valarbringo"]
    assert parse("Tu1pulfulko, R., b. 1827")[0][:5] == ("initial", "tulpulfulko", "r", "", 1827)
    assert {r[0] for r in parse("The Darfathinko Society for Tidal Studies")} == {"body"}
    assert parse("") == [] and parse("?!") == []


def test_segment_join_finds_every_pair_within_two_edits():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        b = "".join(b)
        if not b:
            continue
        long_, short = (a, b) if len(a) >= len(b) else (b, a)
        if edits(len(short)) < 2:  # strings of one or two letters have no two edits
            continue
        assert lookups(long_) & {(len(short), i, s) for i, _, s in segments(short)}
    for a, b, want in [("charles", "csarles", True), ("james", "jmaes", True), ("laurence", "laurnce", True), ("hinval", "hmval", True), ("ab", "ba", True), ("abc", "cba", False), ("anna", "anton", False)]:
        assert one_error(a, b) is want and one_error(b, a) is want


def test_variants(spark):
    groups = [
        ["Hakofeho, Henry, 1793-1854", "HAKOFEHO, Henry (1793-1854)", "Hakofeho, Henry, b. 1793", "Hakofeho, Henry, 1793?-1854", "Hаkоfеho, Henry, １７９３-1854"],
        ["Hakofeho, Henry, 1838-1889"], ["Hakofeho, Julia, 1800-1850", "julia hakofeho"],
        ["Binmintulga, Susanna Laurence, 1835-1921", "S.L. Binmintulga", "Sukey Binmintulga", "Binmintulga, S. L. (Susanna Laurence), 1835-1921", "Dr. Susanna L. Binmintulga", "Binmintluga, Susanna Laurence, 1835-1921"],
        ["Darfathinko Society for Tidal Studies", "The Darfathinko Society for Tidal Studies", "Darfathinko Soc. f. Tidal Studies", "Society for Tidal Studies, Darfathinko"],
        ["Tetharalar University Press", "Tetharalar U.P.", "Univ. Press of Tetharalar"], ["Tethoralur University Press"], ["Harvepene & Sons", "Messrs. Harvepene and Sons"],
    ]
    extra = [None, "", "?"]
    df = spark.createDataFrame([(n, 1) for g in groups for n in g for _ in range(2)] + [(n, 0) for n in extra], "name string, entity int")
    got = {(r.name_a, r.name_b) for r in variant_pairs(df, "name").collect()}
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}
    assert variant_pairs(df.limit(0), "name").count() == 0


def test_doubtful_names_join_nobody(spark):
    names = ["Hakofeho, Henry, 1793-1854", "Hakofeho, Henry, 1838-1889", "H. Hakofeho", "Hakofeho, Henry", "Vinfin, Kate", "Vinfin, Katharine, 1800-1850", "Vinfin, Catherine, 1810-1850"]
    assert variant_pairs(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect() == []


def test_slips_in_second_names_and_short_body_words(spark):
    groups = [
        ["Lultahanar, Felix Samuel, 1739-1818", "LULTAHANAR, Felix Samuel (1739-1818)", "Lultahanar, Felix Samuell, 1739-1818", "Felix Samuel Lultahanar", "Felix Samuol Lultahanar", "F. S. Lultahanar"],
        ["Lultahanar, Felix Robert, 1839-1918"], ["Hakofeho, Henry Martin", "Henry Martin Hakofeho", "Hakofeho, Henry Marton"],
        ["Darfathinko Sea Institute", "The Darfathinko Sea Institute", "Darfathinko Sea Inst.", "Darfathinko Sae Institute"], ["A. Harvepene & Sons", "Messrs. A. Harvepene and Sons"], ["B. Harvepene & Sons"],
    ]
    rows = [(n,) for g in groups for n in g]
    got = {(r.name_a, r.name_b) for r in variant_pairs(spark.createDataFrame(rows, "name string"), "name").collect()}
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}


def test_two_errors_bodies_without_listed_words_and_unexplained_names(spark):
    groups = [
        ["Religious Tract Committee", "Religious Tract Comittee"], ["Ministry of Tidal Affairs", "Tidal Affairs, Ministry of"],
        ["Hakofeho, Henry, 1793-1854", "Hakafehu, Henry, 1793-1854"], ["Hakofeho, Julia, 1800-1850", "Hakafeho, Jalia, 1800-1850"],
        ["Hakofeho, Henry, 1791-1850"], ["Hakofehi, Henry, 1701-1750"],
    ]
    rows = [(n,) for g in groups for n in g]
    got = {(r.name_a, r.name_b) for r in variant_pairs(spark.createDataFrame(rows, "name string"), "name").collect()}
    assert got == {tuple(sorted((a, b))) for g in groups for a in g for b in g if a < b}


def test_words_of_bodies_are_learned_from_the_collection(spark):
    names = [f"{x} Observatory of {y}" for x in ("Royal", "New", "Old") for y in ("Vinfin", "Tulpul", "Darkap")] + ["Hakofeho, Henry, 1793-1854", "Royal, Henry, 1800-1850"]
    learned = body_words(spark.createDataFrame([(n,) for n in names], "name string"))
    assert "observatory" in learned and not learned & {"henry", "hakofeho", "royal", "of"}
    assert {r[0] for r in parse("Valpul Observatory")} == {"person"} and {r[0] for r in parse("Valpul Observatory", learned)} == {"body"}
    assert body_words(spark.createDataFrame([("Henry",)], "name string")) == frozenset()


def test_no_segment_is_empty():
    for n in range(1, 30):
        assert all(s for _, _, s in segments("x" * n))


def made_up_variants(rng, people=120, bodies=30):
    """Names of made-up entities: two plain spellings of each and, by turns, variants of every kind; ``(name, entity, kind)``."""
    syllables = "ba be bo da de di fa fe fo ga go ha he ka ke la le lo ma mi na no pa pe po ra re ri sa se so ta te to va ve vi".split()
    given = "Henry Julia Charles Martha Edmund Helena Oscar Felix Laurence Matilda Percival Cedric Johanna Winifred Theodore".split()
    pets = {"Henry": "Harry", "Martha": "Mattie", "Edmund": "Ned", "Helena": "Nell", "Laurence": "Larry", "Matilda": "Tilda", "Percival": "Percy", "Winifred": "Winnie", "Theodore": "Theo"}
    subjects = ["Tidal Studies", "Night Reading", "Paper Rivers"]
    kinds = ["case", "order", "no_years", "years", "title", "initials", "pet_name", "one_letter", "swap", "two_letters", "look_alike", "accent"]

    def slip(s, n):
        at = rng.sample(range(1, len(s) - 1), n)
        return "".join(rng.choice([c for c in "aeiou" if c != x]) if k in at and x in "aeiou" else ("x" if k in at else x) for k, x in enumerate(s))

    out, seen = [], set()
    for e in range(people):
        sur = "".join(rng.choice(syllables) for _ in range(4)).capitalize()
        if sur in seen:
            continue
        seen.add(sur)
        g, h = rng.choice(given), rng.choice(given)
        b = rng.randrange(1700, 1900)
        life, plain = f"{b}-{b + 60}", f"{sur}, {g} {h}, {b}-{b + 60}"
        out += [(plain, e, "plain"), (f"{sur}, {g} {h} ({life})", e, "plain")]
        made = {"case": plain.upper(), "order": f"{g} {h} {sur}", "no_years": f"{sur}, {g} {h}", "years": f"{sur}, {g} {h}, b. {b}", "title": f"Dr. {g} {h} {sur}", "initials": f"{sur}, {g[0]}. {h[0]}., {life}", "pet_name": f"{sur}, {pets.get(g, g)} {h}, {life}",
                "one_letter": f"{slip(sur, 1)}, {g} {h}, {life}", "swap": f"{sur[:3]}{sur[4]}{sur[3]}{sur[5:]}, {g} {h}, {life}", "two_letters": f"{slip(sur, 2)}, {g} {h}, {life}", "look_alike": plain.replace("a", "а").replace(", ", ", "), "accent": plain.replace("e", "é", 1)}
        out += [(made[k], e, k) for k in kinds]
    for e in range(people, people + bodies):
        sur = "".join(rng.choice(syllables) for _ in range(4)).capitalize()
        s = subjects[e % 3]
        out += [(f"{sur} Society for {s}", e, "plain"), (f"{sur} Soc. for {s}", e, "body_short"), (f"Society for {s}, {sur}", e, "body_order"), (f"The {sur} Society for {s}", e, "body_article"), (f"{sur} Socitey for {s}", e, "body_slip")]
    return out


def test_recall_by_kind_of_variant(spark):
    """Held-out accuracy: of made-up variants each kind is found, and nobody is linked to another."""
    rows = made_up_variants(random.Random(8))
    entity = {n: e for n, e, _ in rows}
    got = {(r.name_a, r.name_b) for r in variant_pairs(spark.createDataFrame(rows, "name string, entity int, kind string"), "name").collect()}
    plain = {}
    for n, e, k in rows:
        if k == "plain":
            plain.setdefault(e, n)
    found, total = {}, {}
    for n, e, k in rows:
        if k != "plain" and n != plain[e]:
            total[k] = total.get(k, 0) + 1
            found[k] = found.get(k, 0) + (tuple(sorted((n, plain[e]))) in got)
    recall = {k: round(found[k] / total[k], 3) for k in total}
    wrong = sum(entity[a] != entity[b] for a, b in got)
    print(recall, wrong, len(got))
    assert wrong <= 0.002 * len(got) and min(recall.values()) >= 0.95
