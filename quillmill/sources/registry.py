"""Column layouts of named corpora, as data: a layout is ``index:field`` pairs, as in column files."""

from __future__ import annotations

# Layouts by task.
LAYOUTS = {
    "ner": "0:text,1:ner", "pos_ner": "0:text,1:pos,2:ner", "conll03": "0:text,1:pos,2:chunk,3:ner", "conll03_german": "0:text,1:lemma,2:pos,3:chunk,4:ner",
    "upos": "0:text,1:upos", "chunk": "0:text,1:chunk", "conll2000": "0:text,1:pos,2:chunk", "aspect": "0:text,1:ast", "atis": "0:text,1:atis", "code_switch": "0:text,1:cs",
    "germeval": "1:text,2:ner", "system": "0:text,1:gold_ner,2:ner,3:score", "punct": "0:text,1:punct",
}
FORMATS = {"column": list(LAYOUTS), "conllu": ["ud", "srl", "ptb", "ctb", "sdp", "enhanced_ud"], "labelled": ["imdb", "newsgroups", "trec_6", "trec_50", "emotion"]}


def parse_layout(layout: str) -> dict[int, str]:
    """``0:text,1:ner`` as a map; exactly one field is the text."""
    out = {int(k): v.strip() for k, v in (x.split(":") for x in layout.split(",") if x.strip())}
    if list(out.values()).count("text") != 1:
        raise ValueError("a layout needs one text column")
    return out


_BY_NAME: dict[str, object] = {}


def register(name: str):
    """Registers a reader or function under a name."""

    def keep(f):
        _BY_NAME[name] = f
        return f

    return keep


def by_name(name: str):
    return _BY_NAME[name]


def available() -> list[str]:
    return sorted(_BY_NAME)


def merged(base: dict, over: dict) -> dict:
    """Two configuration trees as one: nested maps are merged, other values of ``over`` take the place of those of ``base``."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
