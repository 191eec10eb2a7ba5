"""Small tables with the awkward rows every operator has to handle."""

import random

WORDS = ("the of and to in is that it was for on are as with his they at be this have from or one had by word "
         "but not what all were we when your can said there use an each which she do how their if will up other "
         "about out many then them these so some her would make like him into time has look two more write go "
         "see number no way could people my than first water been call who oil its now find long down day did "
         "get come made may part").split()
DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              # names the operators might use themselves
              "id string, t string, d string, fp string, node string, copy_no string, text_digest string, "
              "keep_key string, mixing_rate string, label string, key string, n string, h string, p string")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def awkward_rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "en", "a", 10), (2, base, "en", "b", 10),              # copies
        (3, " ".join(near), "en", "a", 10),                              # near copy
        (4, None, "en", "a", 0), (5, "", None, None, None), (6, " \n\t ", "en", "a", 4),
        (7, prose(2, 60_000), "en", "a", None),                          # very long
        (8, "one two", "en", "a", 7), (8, "one two", "en", "a", 7),      # a repeated row
        (9, "one two", "de", "c", 7), (9, "three four five", "de", "c", 7),   # an id twice
        (10, "x" * 5_000, "en", "a", 5_000), (11, "中文 \U0001f642 é\u0000", "zh", "a", 4),
        (None, "no id here", "en", "a", 3), (None, None, None, None, None),
    ]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) + ("x",) * 14 for r in rows], DOC_SCHEMA)


def awkward(spark):
    return frame(spark, awkward_rows())


def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
