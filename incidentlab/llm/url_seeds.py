"""A small labelled URL table to train the URL filter on.

Its sites are built by rule from broad vocabularies; none is a site that the
registered query judges (a test holds it against the given pages).
"""

from __future__ import annotations

# -- vocabularies (fixed values)
# what sites to block are about: gambling, pills, adult, adverts, spam, fraud
_SPAM = """
casino poker slots betting bets roulette jackpot lottery blackjack bingo pills viagra meds pharma cialis steroids
adult xxx porn sex cams escorts nude dating replica loans payday bitcoin crypto giveaway prize winner spam links
clicks popunder tracker ads adserver banners torrent warez crack keygen cheats miracle forex traffic seo followers
phishing verify unlock wallet
""".split()
_SPAM_TAIL = "bonus online deals hub royal zone direct now cheap free best max 24 club".split()
# what ordinary sites are about
_ORDINARY = """
news city library weather museum recipes history science travel garden council music book health data film sports
photo language art river school college hospital train church market kitchen house family energy climate law
software physics math cooking cycling hiking birds ocean forest village radio theatre opera poetry nature
children teacher student engineer doctor farmer baker tailor bridge castle island mountain harbour station
""".split()
_ORDINARY_TAIL = "daily guide notes journal diary club review service archive gallery online best now hub society".split()
_ONSETS = "b c d f g h j k l m n p r s t v w z br ch cl cr dr fl gr pl pr sh sl sp st str th tr".split()
_VOWELS = "a e i o u ai au ea ei ie io ou".split()
_CODAS = ["", "", "n", "r", "s", "t", "l", "nd", "ng", "nt", "rs", "sh", "st", "th", "ble", "tion", "ly", "er"]
#: made-up names among the ordinary sites: a name that says nothing is no reason to block
MADE_UP = 240

#: urls per site
TURNS = 16
_ENDINGS = (".example.com", ".example.net", ".example.org", ".com", ".net", ".org")
_FRONT = ("", "www.", "m.", "blog.")
_PATHS = ("/en/{n}", "/fr/{n}.html", "/de/{n}/", "/es/{n}?page=2&ref=x", "/en/{n}#top", "/fr/{n}?utm_source=feed")


def _pairs(heads: list[str], tails: list[str]) -> list[str]:
    """Every head alone, before two tails and after two, in turn."""
    said = [(h, tails[(3 * k + 5 * j) % len(tails)], j) for k, h in enumerate(heads) for j in range(4)]
    return heads + [f"{h}-{t}" if j < 2 else f"{t}-{h}" for h, t, j in said]


def _made_up() -> list[str]:
    out, state = [], 1
    while len(out) < MADE_UP:
        name = ""
        for _ in range(1 + len(out) % 3):
            for part in (_ONSETS, _VOWELS, _CODAS):
                state = (state * 1103515245 + 12345) % (1 << 31)
                name += part[(state >> 12) % len(part)]
        if len(name) >= 4:
            out.append(name)
    return out


def blocked_sites() -> list[str]:
    return _pairs(_SPAM, _SPAM_TAIL)


def allowed_sites() -> list[str]:
    return _pairs(_ORDINARY, _ORDINARY_TAIL) + _made_up()


def labelled_urls() -> list[tuple[str, int]]:
    """(url, blocked): every site under ``TURNS`` fronts, endings, paths and numbers
    in turn, so that none of these tells the classes apart."""
    out = []
    for blocked, names in ((1, blocked_sites()), (0, allowed_sites())):
        for k, name in enumerate(names):
            for turn in range(TURNS):
                front, ending, path = _FRONT[(k + turn) % 4], _ENDINGS[(2 * k + turn) % 6], _PATHS[(k + 5 * turn) % 6]
                number = (k * 7919 + turn * 104_729) % 12_007
                out.append((f"https://{front}{name}{ending}{path.format(n=number)}", blocked))
    return out
