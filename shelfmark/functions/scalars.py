"""Scalar functions as column expressions; all of them run in the JVM.

Unknown stays unknown: where a value does not fit a grammar the result is null
(or false for a predicate), never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.operators.packed import fold_column

#: Language codes of two letters with their three-letter and retired forms (fixed values of ISO 639).
LANGUAGES = """aa aar; ab abk; ae ave; af afr; ak aka; am amh; an arg; ar ara; as asm; av ava; ay aym; az aze; ba bak; be bel; bg bul; bi bis; bm bam; bn ben;
bo bod tib; br bre; bs bos; ca cat; ce che; ch cha; co cos; cr cre; cs ces cze; cu chu; cv chv; cy cym wel; da dan; de deu ger; dv div; dz dzo; ee ewe; el ell gre;
en eng; eo epo; es spa; et est; eu eus baq; fa fas per; ff ful; fi fin; fj fij; fo fao; fr fra fre; fy fry; ga gle; gd gla; gl glg; gn grn; gu guj; gv glv; ha hau;
he heb iw; hi hin; ho hmo; hr hrv; ht hat; hu hun; hy hye arm; hz her; ia ina; id ind in; ie ile; ig ibo; ii iii; ik ipk; io ido; is isl ice; it ita; iu iku; ja jpn;
jv jav jw; ka kat geo; kg kon; ki kik; kj kua; kk kaz; kl kal; km khm; kn kan; ko kor; kr kau; ks kas; ku kur; kv kom; kw cor; ky kir; la lat; lb ltz; lg lug; li lim;
ln lin; lo lao; lt lit; lu lub; lv lav; mg mlg; mh mah; mi mri mao; mk mkd mac; ml mal; mn mon; mr mar; ms msa may; mt mlt; my mya bur; na nau; nb nob; nd nde; ne nep;
ng ndo; nl nld dut; nn nno; no nor; nr nbl; nv nav; ny nya; oc oci; oj oji; om orm; or ori; os oss; pa pan; pi pli; pl pol; ps pus; pt por; qu que; rm roh; rn run;
ro ron rum mo mol; ru rus; rw kin; sa san; sc srd; sd snd; se sme; sg sag; si sin; sk slk slo; sl slv; sm smo; sn sna; so som; sq sqi alb; sr srp; ss ssw; st sot; su sun;
sv swe; sw swa; ta tam; te tel; tg tgk; th tha; ti tir; tk tuk; tl tgl; tn tsn; to ton; tr tur; ts tso; tt tat; tw twi; ty tah; ug uig; uk ukr; ur urd; uz uzb; ve ven;
vi vie; vo vol; wa wln; wo wol; xh xho; yi yid ji; yo yor; za zha; zh zho chi; zu zul"""
#: Languages of library catalogues that have a three-letter code only (fixed values of ISO 639).
OTHER_LANGUAGES = tuple("ang arc ast bar ceb chr cop csb enm fil frm fro frr fur gmh goh grc haw ilo myn nah nai nap nds non ota pap peo pro sco scn sga syr tpi".split())
#: Extension kinds of files (fixed values).
KINDS = {
    "ebook_candidate": ("epub",), "pdf_candidate": ("pdf",), "audio_candidate": ("mp3", "m4b", "m4a", "flac", "ogg"),
    "archive_candidate": ("zip", "rar", "7z", "tar", "gz", "bz2", "xz"), "recovery_data": ("par2",),
}
FORMATS = ("all", "epub", "pdf", "mp3", "m4b", "m4a")
STATUSES = ("all", "checked", "review")
#: Identifier grammars (fixed values).
GRAMMARS = {
    "gutenberg": r"^gutenberg:[1-9][0-9]{0,7}$", "pmc": r"^pmc:(PMC[1-9][0-9]{0,9})(?:\.([1-9][0-9]{0,3}))?$",
    "oapen": r"^oapen:20\.500\.12657/([0-9]{1,10})$", "openalex": r"^W[1-9][0-9]{0,11}$",
    "openlibrary_edition": r"^OL[1-9][0-9]*M$", "librivox": r"^librivox:[1-9][0-9]{0,7}$", "doi": r"^10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]{1,300}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "version": r"^[0-9]+\.[0-9]+\.[0-9]+(?:-[a-z0-9.]+)?$",
    "resource": r"^[a-z0-9][a-z0-9._-]{0,100}$", "archive": r"^archive:[A-Za-z0-9][A-Za-z0-9_.-]{0,99}$",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_list(c: Column | str, mark: str = ";") -> Column:
    """Values of a list in one string: folded, empty ones left out; an empty array for null."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), mark), fold_column)
    return F.filter(parts, lambda x: x != "")


def split_codes(c: Column | str) -> Column:
    """A list by ``;``, else by ``,`` if every part is a plain ASCII word, else the one value."""
    x = fold_column(col(c))
    commas = split_list(x, ",")
    ascii_words = F.forall(commas, lambda v: v.rlike("^[A-Za-z0-9-]+$"))
    return F.when(x.contains(";"), split_list(x, ";")).when(ascii_words, commas).otherwise(F.filter(F.array(x), lambda v: v != ""))


def date_shape(c: Column | str) -> Column:
    """Whether a string has the shape YYYY-MM-DD; the calendar is not asked."""
    return col(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def has_grammar(c: Column | str, name: str) -> Column:
    """Whether a string is an identifier of the named grammar."""
    ok = col(c).rlike(GRAMMARS[name])
    return ok & ~F.exists(F.split(col(c), "/"), lambda p: p.isin(".", "..")) if name == "doi" else ok


def language_base(c: Column | str, others: tuple[str, ...] = OTHER_LANGUAGES) -> Column:
    """Base language of a tag that is exactly known, else null: of two letters where it has such a code, or one of ``others``."""
    pairs = [(form, row.split()[0]) for row in LANGUAGES.replace("\n", " ").split(";") for form in row.split()] + [(x, x) for x in others]
    table = F.create_map(*[F.lit(x) for p in pairs for x in p])
    head = F.regexp_extract(F.lower(col(c)), r"^([a-z]{2,3})(?:[-_][a-z0-9]{1,8})*$", 1)
    return F.when(head != "", F.try_element_at(table, head))


def language_match(tags: Column | str, want: str) -> Column:
    """Whether an array of tags has the base language: true, false, or null where no tag is known."""
    known = F.filter(F.transform(col(tags), lambda t: language_base(t)), lambda b: b.isNotNull())
    return F.when(F.size(known) > 0, F.array_contains(known, want))


def digits(c: Column | str) -> Column:
    return F.transform(F.split(col(c), ""), lambda d: d.cast("int"))


def isbn13_ok(c: Column | str) -> Column:
    """Whether 13 digits carry a right check digit."""
    x = col(c)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0),
                        lambda a, i: a + F.substring(x, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return F.coalesce(F.when(x.rlike("^[0-9]{13}$"), total % 10 == 0), F.lit(False))


def isbn10_ok(c: Column | str) -> Column:
    """Whether ten places (the last may be X) carry a right check digit."""
    x = col(c)
    value = lambda i: F.when(F.substring(x, i, F.lit(1)) == "X", 10).otherwise(F.expr("try_cast(0 as int)") + F.substring(x, i, F.lit(1)).try_cast("int"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda a, i: a + value(i) * (F.lit(11) - i))
    return F.coalesce(F.when(x.rlike("^[0-9]{9}[0-9X]$"), total % 11 == 0), F.lit(False))


def isbn13_of(c: Column | str) -> Column:
    """The 13-digit form of a right ISBN-10, else null."""
    body = F.concat(F.lit("978"), F.substring(col(c), 1, 9))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0),
                        lambda a, i: a + F.substring(body, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return F.when(isbn10_ok(c), F.concat(body, ((F.lit(10) - total % 10) % 10).cast("string")))


def clean_isbn(c: Column | str) -> Column:
    """An ISBN without ``urn:isbn:``, hyphens and blanks, in capitals."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(col(c))), "^URN:ISBN:", ""), "[- ]", "")


def canonical_doi(c: Column | str) -> Column:
    """A DOI without resolver prefixes, in small letters, or null."""
    x = F.regexp_replace(F.lower(F.trim(col(c))), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*|urn:doi:)", "")
    return F.when(has_grammar(x, "doi"), x)


def open_library_key(c: Column | str) -> Column:
    """``OL<digits>M`` or ``W`` in capitals, or null."""
    x = F.regexp_extract(F.upper(F.trim(col(c))), r"(?:^|/)(OL[1-9][0-9]*[MW])$", 1)
    return F.when(x != "", x)


def arxiv_parts(c: Column | str) -> Column:
    """Paper and version (0: none stated) of ``arxiv:ID`` or ``arxiv:IDvN``, or null.

    New ids count from 0704, with four digits to 1412 and five from 1501; old ones run from 9108 to 0703.
    """
    body = r"([0-9]{4}\.[0-9]{4,5}|[a-z]+(?:-[a-z]+)*/[0-9]{7})"
    whole = rf"^arxiv:{body}(?:v([1-9][0-9]{{0,3}}))?$"
    paper, old = F.regexp_extract(col(c), whole, 1), F.regexp_extract(col(c), whole, 1).contains("/")
    yymm = F.when(old, F.regexp_extract(paper, r"/([0-9]{4})", 1)).otherwise(F.substring(paper, 1, 4)).try_cast("int")
    month = (yymm % 100).between(1, 12)
    new_ok = ~old & (yymm >= 704) & ((yymm < 1501) == (F.length(paper) == 9))
    old_ok = old & (yymm.between(9108, 9912) | yymm.between(1, 703))
    version = F.coalesce(F.regexp_extract(col(c), whole, 2).try_cast("int"), F.lit(0))
    return F.when((F.octet_length(col(c)) <= 70) & (paper != "") & month & (new_ok | old_ok), F.struct(paper.alias("paper"), version.alias("version")))


def pdf_name(paper: Column | str, version: Column | str) -> Column:
    return F.concat(F.replace(col(paper), F.lit("/"), F.lit("_")), F.lit("v"), col(version).cast("string"), F.lit(".pdf"))


def track_number(c: Column | str) -> Column:
    """``7``, ``07`` or ``7/12`` as 1..9999, else 0."""
    n = F.regexp_extract(F.trim(col(c)), r"^0*([0-9]{1,4})(?:/[0-9]+)?$", 1).try_cast("int")
    return F.coalesce(n, F.lit(0))


def declared_seconds(c: Column | str) -> Column:
    """``507.1``, ``08:26`` or ``1:02:03`` as seconds, else 0; parts after the first stay under 60, the whole at most a million."""
    parts = F.split(F.trim(col(c)), ":")
    nums = F.transform(parts, lambda p: p.try_cast("double"))
    ok = (F.size(parts) <= 3) & F.forall(nums, lambda v: v.isNotNull() & (v >= 0)) & F.forall(F.slice(nums, 2, 3), lambda v: v < 60)
    total = F.aggregate(nums, F.lit(0.0), lambda a, v: a * 60 + v)
    return F.coalesce(F.when(ok & (total <= 1e6), total), F.lit(0.0))


def hex_digest(c: Column | str, n_bytes: int) -> Column:
    return col(c).rlike(f"^[0-9a-f]{{{2 * n_bytes}}}$")


def slug(c: Column | str, limit: int = 60) -> Column:
    """A readable key: small letters and digits joined by hyphens, and eight digits of the text's hash."""
    base = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.substring(base, 1, limit), F.lit("-"), F.substring(F.sha2(col(c), 256), 1, 8))


def file_kind(c: Column | str) -> Column:
    """Kind of file by the extension of its name."""
    ext = F.regexp_extract(F.lower(col(c)), r"\.([^./\\]*)$", 1)
    out = F.lit("other")
    for kind, exts in KINDS.items():
        out = F.when(ext.isin(*exts), kind).otherwise(out)
    return out


def detected_format(head: Column | str) -> Column:
    """Format by the first eight bytes; null for null."""
    x = F.hex(F.substring(col(head), 1, 8))
    frame = x.rlike("^FF[EF]")
    return (F.when(x.startswith("504B0304"), "zip").when(x.startswith("255044462D"), "pdf").when(x.startswith("494433") | frame, "mp3")
            .when(F.substring(x, 9, 8) == "66747970", "mp4").when(x.startswith("52617221"), "rar")
            .when(x.startswith("4D5A") | x.startswith("7F454C46"), "executable").when(x.isNotNull(), "unknown"))


def flag_state(c: Column | str) -> Column:
    """A JSON value as true, false, unknown or not_declared."""
    x = F.lower(F.trim(col(c)))
    return (F.when(col(c).isNull() | (col(c) == ""), "not_declared").when(x.isin("true", '"true"', "1", '"1"'), "true")
            .when(x.isin("false", '"false"', "0", '"0"'), "false").otherwise("unknown"))


def letters_label(n: Column | str) -> Column:
    """a..z, aa..zz, ...: the letter repeated; decimal outside 1..2600."""
    x = col(n)
    letter = F.char(F.lit(97) + (x - 1) % 26)
    return F.when(x.between(1, 2600), F.repeat(letter, (F.floor((x - 1) / 26) + 1).cast("int"))).otherwise(x.cast("string"))


def roman(n: Column | str) -> Column:
    """Small roman numerals for 1..3999, else decimal."""
    x, out = col(n), F.lit("")
    rest = x
    for value, mark in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out = F.concat(out, F.repeat(F.lit(mark), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(x.between(1, 3999), out).otherwise(x.cast("string"))


def scaled_ms(units: Column | str, scale: Column | str) -> Column:
    """Units of a time scale as whole milliseconds, saturating; 0 for scale 0."""
    most = F.lit(9223372036854775807).cast("decimal(38,0)")
    wide = F.floor(col(units).cast("decimal(38,0)") * 1000 / F.nullif(col(scale).cast("decimal(20,0)"), F.lit(0))).cast("decimal(38,0)")
    return F.when(col(scale) == 0, F.lit(0).cast("long")).otherwise(F.least(wide, most).cast("long"))


def packed_language(code: Column | str) -> Column:
    """The three letters of a 15-bit packed language code, or null."""
    x = col(code)
    part = lambda k: F.char(F.lit(96) + F.shiftright(x, k).bitwiseAND(31))
    out = F.concat(part(10), part(5), part(0))
    return F.when(out.rlike("^[a-z]{3}$"), out)


def syncsafe(c: Column | str) -> Column:
    """A 28-bit number of four bytes with seven bits each."""
    x = col(c).cast("long")
    return sum((F.shiftright(x, 8 * k).bitwiseAND(127) * F.lit(1 << (7 * k)) for k in range(4)), F.lit(0))


#: Marks after which a reader pauses, and marks that may close after them (fixed values).
SENTENCE_ENDS, CLAUSE_ENDS, CLOSING = ".!?…。！？", ",;:，、；：", "\"')]}’”»」』）"
#: Words a minute within which words are shown (fixed values).
LEAST_RATE, MOST_RATE = 100, 1000


def _set(marks: str) -> str:
    return "[" + "".join("\\" + m if m in "]\\^-[" else m for m in marks) + "]"


def pause_class(word: Column | str) -> Column:
    """sentence, clause or none, by the last mark of a word after closing quotes and brackets."""
    bare = F.regexp_replace(col(word), _set(CLOSING) + "+$", "")
    return F.when(bare.rlike(_set(SENTENCE_ENDS) + "$"), "sentence").when(bare.rlike(_set(CLAUSE_ENDS) + "$"), "clause").otherwise("none")


def dwell_ms(word: Column | str, rate: int, kind: Column | str | None = None, pause: Column | str | None = None) -> Column:
    """Time in ms (three places) an item is shown at ``rate`` words a minute, held within the rates allowed.

    Words of more than eight characters take 1.3 times as long, a clause end 1.5, a sentence end 2, a paragraph end
    2.5 times; a break takes no time, a gap or heading three words' time and at least 750 ms. ``kind`` is word
    (default), break, gap or heading; ``pause`` is worked out from the word unless given.
    """
    base = 60000.0 / min(max(rate, LEAST_RATE), MOST_RATE)
    at = pause_class(word) if pause is None else col(pause)
    long_ = F.when(F.length(col(word)) > 8, 1.3).otherwise(1.0)
    of_word = F.lit(base) * long_ * F.when(at == "clause", 1.5).when(at == "sentence", 2.0).when(at == "paragraph", 2.5).otherwise(1.0)
    if kind is None:
        return F.round(of_word, 3)
    return F.round(F.when(col(kind) == "break", 0.0).when(col(kind).isin("gap", "heading"), F.lit(max(3 * base, 750.0))).otherwise(of_word), 3)


def one_line(c: Column | str, limit: int) -> Column:
    """Whether a text is one line of 1..``limit`` bytes."""
    return F.octet_length(col(c)).between(1, limit) & ~col(c).rlike(r"[\x00\r\n]")


def portable_path(c: Column | str) -> Column:
    """Whether a path is relative, without empty, dot or reserved parts."""
    parts = F.split(col(c), "/")
    return F.forall(parts, lambda p: (p != "") & ~p.isin(".", "..") & ~p.rlike(r'[\x00-\x1f<>:"\\|?*]|[. ]$'))


def inside(path: Column | str, folder: Column | str) -> Column:
    """Whether a path is a folder or lies below it; slashes at the folder's end say nothing."""
    root = F.regexp_replace(col(folder), "/+$", "")
    return (F.regexp_replace(col(path), "/+$", "") == root) | col(path).startswith(F.concat(root, F.lit("/")))


def volume_of(name: Column | str) -> Column:
    """Set and volume number of an archive part, by the numbered, old and segment schemes; null if it is none."""
    n = F.lower(col(name))
    out = F.lit(None).cast("struct<set:string,number:int,scheme:string>")
    for scheme, pattern, plus in (("part", r"^(.+)\.part([0-9]{1,4})\.rar$", 0), ("7z", r"^(.+)\.7z\.([0-9]{3})$", 0), ("zip", r"^(.+)\.zip\.([0-9]{3,4})$", 0),
                                  ("segment", r"^(.+)\.z([0-9]{2,4})$", 0), ("old", r"^(.+)\.r([0-9]{2})$", 2)):
        hit = F.regexp_extract(n, pattern, 2)
        out = F.when(hit != "", F.struct(F.regexp_extract(n, pattern, 1).alias("set"), (hit.try_cast("int") + plus).alias("number"), F.lit(scheme).alias("scheme"))).otherwise(out)
    return out
