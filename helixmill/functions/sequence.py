"""Residue sequences and structure codes as text: vocabularies, tokens, templates, codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions import hashing

#: The twenty residues in index order, then the unknown one.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
UNKNOWN = "X"
#: Three-letter names in the same order.
RESIDUE_NAMES = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
#: Backbone and side-chain atoms of the 37-atom layout.
ATOM37 = (
    "N", "CA", "C", "CB", "O", "CG", "CG1", "CG2", "OG", "OG1", "SG", "CD", "CD1", "CD2", "ND1", "ND2", "OD1", "OD2", "SD",
    "CE", "CE1", "CE2", "CE3", "NE", "NE1", "NE2", "OE1", "OE2", "CH2", "NH1", "NH2", "OH", "CZ", "CZ2", "CZ3", "NZ", "OXT",
)
#: The token order of the masked-language-model alphabet.
ESM_TOKENS = ("<cls>", "<pad>", "<eos>", "<unk>", *"LAGVSERTIDPKQNFYMHWCXBUZO", ".", "-", "<null_1>", "<mask>")
CLS, PAD, EOS, UNK, MASK = 0, 1, 2, 3, 32
#: The 30-symbol character vocabulary.
CHAR_TOKENS = ("<|pad|>", "<|bos|>", "<|eos|>", "1", "2", *"ABCDEFGHIKLMNOPQRSTUVWXYZ")
MODALITY_OFFSET = 33
IGNORE = -100
CHAIN_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _map(tokens):
    return F.create_map(*[F.lit(x) for i, t in enumerate(tokens) for x in (t, i)])


def chars(text):
    """Characters of a string; none for ''."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def aatype(seq):
    """Residue letters -> indices; unknown letters -> 20."""
    return F.transform(chars(seq), lambda c: F.coalesce(F.nullif(F.instr(F.lit(RESIDUES), c), F.lit(0)) - 1, F.lit(20)))


def sequence_of(indices):
    """Residue indices -> letters."""
    letters = F.array(*map(F.lit, RESIDUES + UNKNOWN))
    return F.array_join(F.transform(indices, lambda i: F.get(letters, F.least(F.greatest(i, F.lit(0)), F.lit(20)))), "")


def esm_tokens(text):
    """Special tokens whole, everything else by character, white space dropped."""
    return F.regexp_extract_all(text, F.lit(r"<[a-z_0-9]+>|[^\s]"), F.lit(0))


def esm_ids(text, strict: bool = False):
    """Token ids; an unknown token is <unk>, or null if strict."""
    table = _map(ESM_TOKENS)
    return F.transform(esm_tokens(text), lambda t: F.element_at(table, t) if strict else F.coalesce(F.element_at(table, t), F.lit(UNK)))


def wrapped(ids, bos: int = CLS, eos: int = EOS, limit: int | None = None):
    """[bos] + at most `limit` ids + [eos]."""
    ids = F.slice(ids, 1, limit) if limit is not None else ids
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def padded(ids, length, value: int, left: bool = False):
    """ids filled up with value to length."""
    fill = F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def char_ids(seq):
    """Ids of the 30-symbol vocabulary; symbols outside it are dropped."""
    table = _map(CHAR_TOKENS)
    return F.filter(F.transform(chars(seq), lambda c: F.element_at(table, c)), lambda i: i.isNotNull())


def struct_token(code):
    """<|s0001|>; ids from 10000 on would not parse and are an error."""
    return F.when(code < 10000, F.concat(F.lit("<|s"), F.lpad(code.cast("string"), 4, "0"), F.lit("|>"))).otherwise(F.raise_error(F.concat(F.lit("structure code out of range: "), code.cast("string"))))


def train_text(seq, codes):
    """<seq>A B C</seq><struct>...</struct>"""
    return F.concat(F.lit("<seq>"), F.array_join(chars(seq), " "), F.lit("</seq><struct>"), F.array_join(F.transform(codes, struct_token), ""), F.lit("</struct>"))


def prompt(seq):
    return F.concat(F.lit("<seq>"), F.array_join(chars(seq), " "), F.lit("</seq><struct>"))


def struct_blocks(text):
    """Bodies of complete structure blocks."""
    return F.regexp_extract_all(text, F.lit(r"<struct>((?:<\|s[0-9]{4}\|>)+)</struct>"), F.lit(1))


def struct_codes(text, skip_first: bool = False):
    """Integer codes of all structure blocks of a text, in order."""
    blocks = struct_blocks(text)
    blocks = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))) if skip_first else blocks
    return F.transform(F.regexp_extract_all(F.array_join(blocks, ""), F.lit(r"<\|s([0-9]{4})\|>"), F.lit(1)), lambda c: c.cast("int"))


def codes_text(codes):
    """Zero-padded comma list."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(c.cast("string"), 4, "0")), ",")


def codes_from_text(text):
    return F.transform(F.filter(F.split(text, ","), lambda c: c != ""), lambda c: c.cast("int"))


def modality(token_id, offset: int = MODALITY_OFFSET):
    """1 for residue ids, 0 for structure ids."""
    return F.when(token_id < offset, 1).otherwise(0)


def residues_only(text):
    """Decoded text without special tokens, X read as G."""
    return F.translate(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"\s", ""), "X", "G")


def truncated(sample, terminals=("1", "2")):
    """Sample up to and including the first terminal after its first character."""
    places = [F.nullif(F.locate(t, sample, 2), F.lit(0)) for t in terminals]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.when(first.isNull(), sample).otherwise(F.substring(sample, F.lit(1), first))


def chain_name(number):
    """0 -> A ... 61 -> 9, then two characters, least significant first: bijective base 62."""
    c = lambda i: F.substring(F.lit(CHAIN_ALPHABET), i.cast("int") + 1, F.lit(1))
    high = F.floor(number / 62) - 1
    return F.when(number < 62, c(number)).when(high < 62, F.concat(c(high), c(number % 62))).otherwise(F.concat(c(F.floor(high / 62) - 1), c(high % 62), c(number % 62)))


def chain_number(name):
    """Inverse of chain_name."""
    return F.aggregate(F.transform(chars(name), lambda c: F.instr(F.lit(CHAIN_ALPHABET), c)), F.lit(0), lambda acc, d: acc * 62 + d) - 1


def stem(file_name):
    """File name without .gz and structure suffixes, and nothing more."""
    return F.regexp_replace(file_name, r"(\.(cif|mmcif|pdb))?(\.gz)?$", "")


def clean_alignment(seq, keep_gaps: bool = True, keep_insertions: bool = True, to_upper: bool = False):
    """Rows of an alignment: without gaps, without lower-case insertions, or upper-cased."""
    seq = seq if keep_gaps else F.regexp_replace(seq, "-", "")
    seq = seq if keep_insertions else F.regexp_replace(seq, "[a-z]", "")
    return F.upper(seq) if to_upper else seq


def without_insertions(seq):
    """Without lower-case letters, dots and stars."""
    return F.regexp_replace(seq, r"[a-z.*]", "")


def mutation(code):
    """A123B -> struct(wild, place, mutant)."""
    part = lambda i: F.regexp_extract(code, r"^([A-Z])([0-9]+)([A-Z])$", i)
    return F.struct(part(1).alias("wild"), F.nullif(part(2), F.lit("")).cast("int").alias("place"), part(3).alias("mutant"))


def mutation_score(seq, code, log_probs, alphabet: str, offset: int = 1):
    """Log-probability of the mutant less that of the wild type; log_probs has a row per token, the first for the start.

    A wild type that is not what the sequence has there is an error, as is a code of another form.
    """
    m = mutation(code)
    place = m["place"] - offset
    row = F.get(log_probs, place + 1)
    at = lambda letter: F.get(row, F.instr(F.lit(alphabet), letter) - 1)
    fits = F.coalesce((place >= 0) & (F.substring(seq, place + 1, F.lit(1)) == m["wild"]), F.lit(False))
    return F.when(fits, at(m["mutant"]) - at(m["wild"])).otherwise(F.raise_error(F.concat(F.lit("wild type does not match: "), code)).cast("double"))


def fill_template(length, start, segment, mask: str = "#"):
    """A run of mask characters with a segment laid over it at start (from 1)."""
    return F.overlay(F.repeat(F.lit(mask), length), segment, start)


def substitute(seq, place, letter):
    """One residue replaced; place from 0."""
    return F.overlay(seq, letter, place + 1, F.lit(1))


def delete(seq, place):
    return F.concat(F.substring(seq, F.lit(1), place), F.substring(seq, place + 2, F.length(seq)))


def insert(seq, place, letter):
    return F.concat(F.substring(seq, F.lit(1), place), letter, F.substring(seq, place + 1, F.length(seq)))


#: States of the structured-text grammar, and the tokens that move between them.
GRAMMAR = {"text": {"<seq>": "seq", "<struct>": "struct", "<eos>": "end"}, "seq": {"</seq>": "text"}, "struct": {"</struct>": "text"}, "end": {}}


def grammatical(tokens):
    """Whether a token array is a complete text: blocks closed, residues in seq, codes in struct, nothing after the end."""
    step = lambda state, t: (
        F.when((state == "text") & (t == "<seq>"), "seq")
        .when((state == "text") & (t == "<struct>"), "struct")
        .when((state == "text") & (t == "<eos>"), "end")
        .when((state == "seq") & (t == "</seq>"), "text")
        .when((state == "struct") & (t == "</struct>"), "text")
        .when((state == "seq") & t.rlike("^[A-Z]$"), "seq")
        .when((state == "struct") & t.rlike(r"^<\|s[0-9]{4}\|>$"), "struct")
        .otherwise("bad")
    )
    return F.aggregate(tokens, F.lit("text"), lambda state, t: step(state, t)) == "end"


def spacers(n, low, high, seed, key):
    """n - 1 lengths, the i-th (from 0) a whole number in [low(i), high(i)] drawn by the hash of seed, key and i; none for fewer than two segments."""
    drawn = lambda i: low(i) + F.floor(hashing.uniform(seed, F.concat(key.cast("string"), F.lit("-"), i.cast("string"))) * (high(i) - low(i) + 1)).cast("int")
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), drawn)).otherwise(F.array().cast("array<int>"))


def assembled(segments, gaps, mask: str = "<mask>"):
    """Segments in order with so many masks between each two; gaps holds one number less than there are segments."""
    runs = F.concat(F.array(F.lit("")), F.transform(gaps, lambda g: F.repeat(F.lit(mask), g)))
    return F.array_join(F.zip_with(runs, segments, lambda r, s: F.concat(r, s)), "")
