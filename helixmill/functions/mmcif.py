"""mmCIF text to categories: single items, loops, quoted and multi-line values."""

from __future__ import annotations

import re

#: A token: text between lines that begin with ';', a quoted value, a comment, or a bare word.
TOKEN = re.compile(
    r"""^;(?P<text>.*?)(?:\r?\n;|\Z(?P<open>))      # ends at a line that begins with ';'
      | '(?P<single>(?:[^'\r\n]|'(?=\S))*)'(?=\s|\Z)  # a quote inside is followed by no white space
      | "(?P<double>(?:[^"\r\n]|"(?=\S))*)"(?=\s|\Z)
      | (?P<comment>\#[^\r\n]*)
      | (?P<word>\S+)""",
    re.M | re.S | re.X,
)


def tokens(text: str):
    """(kind, value): kind is word for bare words, else value."""
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "open":
            raise ValueError("a multi-line value has no end")
        if kind == "word":
            if m["word"][0] in "'\"":
                raise ValueError(f"a quoted value has no end: {m['word'][:20]}")
            yield "word", m["word"]
        elif kind != "comment":
            yield "value", m[kind]


def categories(text: str) -> dict[str, dict[str, list[str]]]:
    """The first data block: category -> item -> values, a list for single items, too. '.' and '?' stand as they are."""
    out: dict[str, dict[str, list[str]]] = {}
    names: list[str] = []
    values: list[str] = []
    heads = looping = False

    def close():
        if not names:
            return
        if looping and len(values) % len(names) or not looping and len(values) != 1:
            raise ValueError(f"{names[0]}: {len(values)} values for {len(names)} items")
        for i, n in enumerate(names):
            category, _, item = n.partition(".")
            out.setdefault(category, {})[item] = values[i :: len(names)]

    blocks = 0
    for kind, value in tokens(text):
        low = value.lower() if kind == "word" else ""
        if low.startswith("data_"):
            blocks += 1
            if blocks > 1:
                break
            continue
        if low == "loop_":
            close()
            names, values, heads, looping = [], [], True, True
        elif kind == "word" and value[0] == "_" and (heads or not looping or not names or len(values) % len(names) == 0):
            if not heads:
                close()
                names, values, looping = [], [], False
            names.append(value)
        else:
            if not names:
                raise ValueError(f"a value without an item: {value[:20]}")
            heads = False
            values.append(value)
    close()
    return out


def first(cats: dict, category: str, item: str) -> str | None:
    """The first known value of an item."""
    return next((v for v in cats.get(category, {}).get(item, []) if v not in (".", "?")), None)


#: Items that may hold a resolution, in the order in which they are asked.
RESOLUTION = (("_refine", "ls_d_res_high"), ("_em_3d_reconstruction", "resolution"), ("_reflns", "d_resolution_high"))


def header(cats: dict) -> tuple[float, str | None, str | None, str | None]:
    """Resolution (0 if there is none), method, oligomeric counts and details, lower case and comma-joined."""
    resolution = 0.0
    for category, item in RESOLUTION:
        value = first(cats, category, item)
        if value is not None:
            resolution = float(value)
            break
    joined = lambda c, i: ",".join(cats[c][i]).lower() if i in cats.get(c, {}) else None
    return resolution, joined("_exptl", "method"), joined("_pdbx_struct_assembly", "oligomeric_count"), joined("_pdbx_struct_assembly", "oligomeric_details")
