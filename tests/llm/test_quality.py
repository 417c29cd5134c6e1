import pytest
from pyspark.sql import functions as F

from tagloom.llm.quality import FIELDS, _common_at, common_path, own_text, statistics_column, text_statistics

NAMES = [x.partition(" ")[0] for x in FIELDS.split(", ")]
PROSE = "The boiler was too loud for the room, so we moved it to the shed. Nobody has complained since."


def stats(text, common=frozenset()):
    return dict(zip(NAMES, text_statistics(text, common)))


def kind(text):
    return stats(text)["kind"]


@pytest.mark.parametrize(
    "text, own",
    [
        ("> quoted\n> more\nmine", "mine"),
        ("On Tue, somebody wrote:\n> quoted\n\nmine", "mine"),
        ("On Tue, somebody wrote:\n\n> quoted\nmine", "mine"),
        ("[quote=a]x [quote]y[/quote]\nz[/quote]\nmine", "mine"),
        ("<blockquote>x<blockquote>y</blockquote></blockquote>\nmine", "mine"),
        ("<blockquote><blockquote>cut off</blockquo</blockquote>\nmine", "mine"),
        ("[quote=b]x\n[/quote] [b] left over [/quote]\nmine", "mine"),
        ("[quote]never closed", "[quote]never closed"),
        ("mine\r\n-- \r\nSent from my phone", "mine"),
        ("mine\n____\nline one\nline two", "mine"),
        ("mine > quoted more", "mine\nmore"),
        ("-- \nonly a signature", ""),
        ("a\n--\n" + "long text " * 100, "a\n--\n" + ("long text " * 100).strip()),
    ],
)
def test_own_text(text, own):
    assert own_text(text) == own


@pytest.mark.parametrize(
    "expected, text",
    [
        ("prose", PROSE),
        ("prose", PROSE.upper()),
        ("prose", "ok"),
        ("prose", "[deleted]"),
        ("prose", "Я вчера купил новую лампу, но она не работает. Сосед говорит, что так и надо."),
        ("prose", "昨日ポンプを直したが、まだ動かない。新しいねじを買いました。"),
        ("prose", "  ".join(PROSE.split())),
        ("prose", "\n".join(PROSE[i : i + 20] for i in range(0, len(PROSE), 20))),
        ("prose", PROSE + "\n\n- big pump\n- small pump\n\n" + PROSE),
        ("prose", PROSE + "\n2022-08-19 08:18 [ERR] pump rc=6\n" + PROSE),
        ("prose", "> a | b | c\n> 1 | 2 | 3\n> 4 | 5 | 6\n> 7 | 8 | 9\n" + PROSE),
        ("prose", "Buy our pumps at http://pump.example today! You will save 40% on every hose."),
        ("prose", "Works for me.\n\nClub treasurer 2009-2015 | all opinions mine"),
        ("list", "Parts needed\n- pump\n- hose\n- 3 valves (20 cm)\n- glue"),
        ("list", "\n\n".join(f"{i}. dry the noisy fuse" for i in range(9)) + "\n\n" + PROSE[:60]),
        ("list", "\n".join(f"{c}) quick switch, garden and ladder" for c in "abcdef")),
        ("list", "[ ] mend the pump\n[x] buy glue\n[ ] sell the boat\n[ ] rest"),
        ("list", "\n".join(f"<li>{w} pump</li>" for w in ("old", "new", "big", "red"))),
        ("list", "Packing list\nThread\nGutter\nCrust\nPump\nHedge\nRim"),
        ("list", "Violin: 49\nBeehive: 193\nHarness: 265\nDrill: 108"),
        ("list", "\n".join(f"-> {i} m hose" for i in range(5))),
        ("table", "Here are my numbers.\n| a | b |\n|---|---|\n| pump | 3 |\n| hose | 4.5 |\n| - | new |"),
        ("table", "Pump\tHose\tLid\na\t1\t2\nb\t-\t4\nc\t5\t6"),
        ("table", "Pump;Hose;Lid\na;1;2\nb;-;4\nc;5;6"),
        ("table", "Pump,Hose,Lid\na,1,2\nb,-,4\nc,5,6"),
        ("table", "Pump      Hose     Lid\na         1        2\nb         -        4\nc         5        6"),
        ("table", "\n".join(f"<tr><td>a{i}</td><td>{i}</td></tr>" for i in range(5))),
        ("table", "│ Pump │ Hose │\n│ a │ 1 │\n│ b │ 2 │\n│ c │ 3 │\n" + PROSE[:30]),
        ("junk", "-" * 70 + "\n" + "-" * 65 + "\n" + "-" * 72),
        ("junk", "+=+=+=+=+=+=+=\n+=+=+=+=+=+=+=+=\n+=+=+=+=+"),
        ("junk", "My screen shows only this:\n" + "🪵🐝🧲🔥🪚" * 20),
        ("junk", "\n".join(f"{i:08x}  f0 80 53 9d 1f 1e 8a da 65 e9 72 81" for i in range(8))),
        ("junk", "\n".join(["EeX9zUTTbRguyATZlZUC412+PhSk6jgW8DDSPFjp9K+qG9uVo80S3w2TKX902S5w"] * 2)),
        ("junk", "\n".join(f"2023-09-06 07:28:{i:02d} [DBG] pump.c:161 rc={i}" for i in range(9))),
        ("junk", "http://a.example/1\nhttp://b.example/2?id=5\nhttps://c.example"),
        ("junk", "Home » Next » Login » FAQ » Prev » Top » Share » Home » FAQ"),
        ("junk", "[b] </div> &nbsp; [/url] <br /> {{0}} [img] &amp;amp; <span> [/b]"),
        ("junk", "valve " * 60),
        ("junk", (PROSE + "\n\n") * 8),
        ("junk", (PROSE + "\n") * 8),
        ("prose", PROSE + "\n\n" + PROSE[::-1] + "\n\n" + PROSE),
        ("junk", "My screen shows only this:\nkdgz iequifrz ig;uou grqhw,he,oro zagak daozhauh owhlpit fjzw,utlswk;f ahd ulwtje;;we iktwshuh pkh,uofrao"),
        ("prose", "Il nostro vicino ha comprato una vecchia pompa, ma non funziona ancora; domani proviamo con un altro motore."),
        ("list", "834 ml speaker; 166 ml chisel; 346 g oven; 573 tbsp speaker; 245 pcs manual"),
        ("list", "For sale:\nnew ladder, rope and thermostat; careful paint, bracket and warranty; spare shop, lathe and paint; lid"),
        ("list", "292 pcs stove\n513 m shop\n807 m glue\n799 g lathe\n650 g capacitor\n166 pcs lid"),
        (None, " \n\t "),
        (None, ""),
        (None, None),
    ],
)
def test_kinds(expected, text):
    assert kind(text) == expected


def test_numbers():
    s = stats("One two two.\n\nOne two two.\nLast line here", frozenset({"one", "two"}))
    assert (s["n_chars"], s["n_own_chars"], s["n_words"], s["n_lines"]) == (41, 41, 9, 3)
    assert s["mean_word_len"] == pytest.approx(30 / 9)
    assert s["symbol_ratio"] == pytest.approx(2 / 32)
    assert s["line_end_share"] == pytest.approx(2 / 3)
    assert s["common_share"] == pytest.approx(6 / 9)
    assert s["duplicate_line_share"] == pytest.approx(12 / 38)
    assert s["duplicate_paragraph_share"] == 0
    assert s["dominant_share"] == pytest.approx(18 / 30)


def test_null_and_blank():
    assert set(text_statistics(None)) == {None} and len(text_statistics(None)) == len(NAMES)
    assert stats("  ")["n_chars"] == 2 and stats("  ")["n_words"] == 0


def test_unclosed_tags_take_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        text = "[quote]x\n[/quote] more " * n
        assert own_text(text) == text.strip()
        own_text("[quote]x " * n + "\n[/quote]\nmine")
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]
    assert own_text("[quote]x " * 9 + "\n[/quote]\nmine") == "mine"


def test_very_long_text():
    s = stats((PROSE + "\n") * 20_000)
    assert s["n_lines"] == 20_000 and s["duplicate_line_share"] > 0.99


def test_column(spark):
    texts = [None, "", PROSE, "- a\n- b\n- c\n- d", "x" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").withColumn("kind", F.lit("clash"))
    words = spark.createDataFrame([("en", "The"), ("en", "was"), (None, None)], "lang string, word string")
    path = common_path(words)
    common = _common_at(path)
    assert common == {"the", "was"}
    got = {r["id"]: tuple(r["s"]) for r in df.select("id", statistics_column(F.col("text"), path).alias("s")).collect()}
    assert got == {i: text_statistics(t, common) for i, t in enumerate(texts)}
    assert df.limit(0).select(statistics_column(F.col("text"))).collect() == []
