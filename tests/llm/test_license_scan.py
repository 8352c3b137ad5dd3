"""Licence scan: own texts against the SQL, and what the positional index finds."""

from check_oracle import compare
from texts import body, odd_texts, write_documents

from signaldeck.llm import license_scan as ls
from signaldeck.llm.catalog import ORACLES, QUERIES

MIT = next(t.text for t in ls.TEMPLATES if len(t.words) > 30)


def texts():
    out = [t.text for t in ls.TEMPLATES]
    out += [f"{body(k)}\n{t.text}, {body(k + 1)}" for k, t in enumerate(ls.TEMPLATES)]
    words = MIT.split()
    out += [" ".join([*words[:3], "really", "and", "truly", *words[3:]]), " ".join(words[20:]), " ".join(words[::-1]), " ".join(words[::2])]
    out += ["CC BY cc-by CC_BY ccby", "all rights reserved " * 300, "General\nPublic \t License. rights reserved all", "éCC by", "all rights all rights reserved"]
    return [*odd_texts().values(), *out]


def test_against_sql(spark, tmp_path, duck):
    rows = list(enumerate(texts()))
    write_documents(spark, tmp_path, [*rows, (3, MIT), (None, MIT), (None, None)])
    got = QUERIES["op13_license_scan"](spark, str(tmp_path)).toPandas()
    assert compare(got, duck(tmp_path, "documents").execute(ORACLES["op13_license_scan"]).df()) == "ok"
    assert (got.labels != got.base_labels).sum() > 2 * len(ls.TEMPLATES) - 4


def index(*more):
    held = {}
    for text in [*(t.text for t in ls.TEMPLATES), *more]:
        for w in set(ls.fold_words(text.encode())):
            held[w] = held.get(w, 0) + 1
    return ls.RareWordIndex(ls.TEMPLATES, held)


def test_place_and_share():
    found = index().matches(ls.fold_words(f"one two three {MIT}".encode()))
    assert ("mit", 3, 1.0) in found
    # Cut off in front: the template starts before the text, its first phrase is missing.
    assert not index().matches(ls.fold_words(" ".join(MIT.split()[20:]).encode()))


def test_rare_words_alone_are_no_licence():
    words = sorted(ls.fold_words(MIT.encode()))
    assert index().matches(words) == [] and index().matches([b"mit", b"the", b"license"]) == []


def test_phrase_starts():
    words = b"all rights all rights reserved rights reserved all rights reserved".split()
    assert ls.phrase_starts(words, [b"all", b"rights", b"reserved"]) == [2, 7]
    assert ls.phrase_starts([b"reserved"], [b"all", b"rights", b"reserved"]) == []
