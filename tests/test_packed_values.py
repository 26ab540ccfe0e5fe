import random

import pytest

from benthos.operators import packed_values as V

MARKS = {"\t", "\n", ",", " /", ";", "|", " •", "、", "，", "；"}


def items(s, delimiters=MARKS):
    return [x for p in V.cuts(s, delimiters) if (x := V.clean(p))]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1) saddled hawkfish, 2) Ribbon eel", ["saddled hawkfish", "Ribbon eel"]),
        ("hooded fish, speckled blenny, and lattice jelly", ["hooded fish", "speckled blenny", "lattice jelly"]),
        ('a; "silt | clay mix"; \'moray; juvenile\'; “crab, hermit”;;', ["a", "silt | clay mix", "moray; juvenile", "crab, hermit"]),
        ("2 cm; 57,6 cm,“77,8 cm”", ["2 cm", "57,6 cm", "77,8 cm"]),
        ("[1, 2, 3, 4], [5,6,7,8]", ["[1, 2, 3, 4]", "[5,6,7,8]"]),
        ("wreck's hatch / Tavor's chromis / fisher's weight.", ["wreck's hatch", "Tavor's chromis", "fisher's weight"]),
        ('the "old" mooring | "a ""b"" c"', ['the "old" mooring', 'a "b" c']),
        ("- sponge (barrel, large)\n- ray - blue spotted\n", ["sponge (barrel, large)", "ray - blue spotted"]),
        ("石斑鱼、海星；'章鱼'", ["石斑鱼", "海星", "章鱼"]),
        ("lone", ["lone"]),
        ('"open, one; two', ['"open', "one", "two"]),
        ("a, b,", ["a", "b"]),
        ("'a, b'\tc d\t“e f”", ["a, b", "c d", "e f"]),
        ("black/white eel / ray", ["black/white eel", "ray"]),
        ("", []),
        (" , ;\n", []),
    ],
)
def test_items(text, expected):
    assert items(text) == expected


def test_long_text_is_linear():
    assert len(items("'a [b \"c, " * 20_000)) == 10_000  # the double quotes pair up


def test_split_values_with_nulls_repeats_and_clashing_columns(spark):
    rows = [("s", "f", 1, 1, "a; b; b"), ("s", "f", 1, 1, "a; b; b"), (None, "f", 2, 0, "x"), ("s", "f", 3, 0, None), ("s", "f", 4, 0, "  "), ("s", None, 5, 0, "rock and sand; p q; r s")]
    df = spark.createDataFrame(rows, "source string, field_name string, row_key long, turn int, answer string").selectExpr("*", "1 AS pos", "'z' AS item", "2 AS delimiters")
    got = sorted((r.row_key, r.pos, r.item) for r in V.split_values(df).collect())
    assert got == sorted([(1, 1, "a"), (1, 2, "b"), (1, 3, "b")] * 2 + [(2, 1, "x"), (5, 1, "rock and sand"), (5, 2, "p q"), (5, 3, "r s")])
    assert V.split_values(df.limit(0)).count() == 0


def inferred(spark, rows):
    found = V.infer_delimiters(spark.createDataFrame(rows, "source string, answer string")).collect()
    return {r.source: set(r.delimiters) for r in found}


def test_delimiters_come_from_the_data(spark):
    """Marks and words that no list names, and marks inside values, by source."""
    rng = random.Random(1)
    fish = ["red fish", "blue ray", "eel", "old rope", "coral wall", "grey seal"]
    people = [f"{w}, {c}" for w in ("Doe", "Smith", "Lee", "Kent") for c in "AJK"]
    kinds = {
        "names": (people, "; ", ";"),
        "slash": (["and/or", "red/blue fish", "eel", "a/b", "grey seal"], "; ", ";"),
        "tilde": (fish, " ~ ", " ~"),
        "hash": (fish, " # ", " #"),
        "arrow": (fish, " -> ", " ->"),
        "spanish": (["pez rojo", "raya azul", "anguila", "foca gris"], " y ", " y "),
        "german": (["roter Fisch", "blauer Rochen", "Aal", "alte Leine"], " und ", " und "),
        "rubble": ([*fish, "sand and rubble", "ray - spotted"], "; ", ";"),
        "lines": (fish, "\n", "\n"),
    }
    rows = [(source, sep.join(rng.choice(values) for _ in range(rng.randint(1, 6)))) for source, (values, sep, _) in kinds.items() for _ in range(400)]
    assert inferred(spark, rows) == {source: {mark} for source, (_, _, mark) in kinds.items()}
    assert items("Doe, A; Smith, J", {";"}) == ["Doe, A", "Smith, J"]
    assert items("roter Fisch und Aal und 'Hai und Rochen'", {" und "}) == ["roter Fisch", "Aal", "Hai und Rochen"]


def test_rows_of_mixed_delimiters(spark):
    rng = random.Random(2)
    words = ["red fish", "blue ray", "eel", "old rope", "feather-star", "diver's weight"]
    mixed = ["".join(rng.choice(words) + rng.choice([", ", "; ", " | "]) for _ in range(5)) + "crab" for _ in range(60)]
    plain = [", ".join(rng.choices(words, k=4)) for _ in range(100)]
    assert inferred(spark, [("s", a) for a in mixed + plain] + [("none", None), (None, "lone")]) == {"s": {",", ";", " |"}, "none": set(), "": set()}
