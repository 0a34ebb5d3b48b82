"""Fixed values of the domain: story arcs, cast, stop words, patterns and thresholds."""

from __future__ import annotations

# Arcs as (first episode, last episode, name).
ARCS = [
    (1, 5, "Prologue"),
    (6, 19, "Land of Waves"),
    (20, 67, "Chūnin Exams"),
    (68, 80, "Konoha Crush"),
    (81, 100, "Search for Tsunade"),
    (101, 106, "Land of Tea (filler)"),
    (107, 135, "Sasuke Recovery Mission"),
    (136, 220, "Post-Recovery (filler)"),
]
UNKNOWN_ARC = "Unknown"

# Canonical names and the phrases that stand for them.
CAST = {
    "Naruto": ["Naruto", "Naruto Uzumaki", "Uzumaki Naruto"],
    "Sasuke": ["Sasuke", "Sasuke Uchiha", "Uchiha Sasuke"],
    "Sakura": ["Sakura", "Sakura Haruno", "Haruno Sakura"],
    "Kakashi": ["Kakashi", "Kakashi Hatake", "Hatake Kakashi", "Kakashi Sensei"],
    "Iruka": ["Iruka", "Iruka Umino", "Iruka Sensei"],
    "Hiruzen": ["Hiruzen", "Hiruzen Sarutobi", "Third Hokage", "Lord Third"],
    "Konohamaru": ["Konohamaru"],
    "Ebisu": ["Ebisu"],
    "Mizuki": ["Mizuki"],
    "Zabuza": ["Zabuza", "Zabuza Momochi"],
    "Haku": ["Haku"],
    "Tazuna": ["Tazuna"],
    "Inari": ["Inari"],
    "Gato": ["Gato", "Gatō"],
    "Rock Lee": ["Rock Lee", "Lee"],
    "Neji": ["Neji", "Neji Hyuga", "Neji Hyūga"],
    "Tenten": ["Tenten"],
    "Guy": ["Guy", "Might Guy", "Gai", "Guy Sensei"],
    "Hinata": ["Hinata", "Hinata Hyuga", "Hinata Hyūga"],
    "Kiba": ["Kiba", "Kiba Inuzuka"],
    "Akamaru": ["Akamaru"],
    "Shino": ["Shino", "Shino Aburame"],
    "Kurenai": ["Kurenai", "Kurenai Sensei"],
    "Shikamaru": ["Shikamaru", "Shikamaru Nara"],
    "Choji": ["Choji", "Chōji", "Choji Akimichi", "Chouji"],
    "Ino": ["Ino", "Ino Yamanaka"],
    "Asuma": ["Asuma", "Asuma Sarutobi", "Asuma Sensei"],
    "Gaara": ["Gaara"],
    "Kankuro": ["Kankuro", "Kankurō"],
    "Temari": ["Temari"],
    "Baki": ["Baki"],
    "Orochimaru": ["Orochimaru", "Lord Orochimaru"],
    "Kabuto": ["Kabuto", "Kabuto Yakushi"],
    "Jiraiya": ["Jiraiya", "Pervy Sage", "Pervy Hermit", "Ero-Sennin", "Pervert Sage"],
    "Tsunade": ["Tsunade", "Lady Tsunade", "Granny Tsunade", "Fifth Hokage"],
    "Shizune": ["Shizune"],
    "Itachi": ["Itachi", "Itachi Uchiha"],
    "Kisame": ["Kisame", "Kisame Hoshigaki"],
    "Hayate": ["Hayate", "Hayate Gekko"],
    "Anko": ["Anko", "Anko Mitarashi"],
    "Ibiki": ["Ibiki", "Ibiki Morino"],
    "Hiashi": ["Hiashi"],
    "Hanabi": ["Hanabi"],
    "Dosu": ["Dosu"],
    "Zaku": ["Zaku"],
    "Kin": ["Kin"],
    "Kimimaro": ["Kimimaro"],
    "Tayuya": ["Tayuya"],
    "Kidomaru": ["Kidomaru", "Kidōmaru"],
    "Jirobo": ["Jirobo", "Jirōbō"],
    "Sakon": ["Sakon"],
    "Ukon": ["Ukon"],
    "Minato": ["Minato", "Fourth Hokage"],
    "Pakkun": ["Pakkun"],
    "Gamabunta": ["Gamabunta", "Chief Toad"],
    "Kyuubi": ["Nine-Tailed Fox", "Nine Tails", "Kyuubi", "Nine-Tails"],
    "Teuchi": ["Teuchi"],
    "Ayame": ["Ayame"],
    "Tonton": ["Tonton"],
    "Tsume": ["Tsume"],
    "Hana": ["Hana"],
    "Shikaku": ["Shikaku"],
    "Inoichi": ["Inoichi"],
    "Choza": ["Choza", "Chōza"],
    "Kotetsu": ["Kotetsu"],
    "Izumo": ["Izumo"],
    "Genma": ["Genma"],
    "Raido": ["Raido"],
    "Shiranui": ["Shiranui"],
    "Yashamaru": ["Yashamaru"],
    "Kazekage": ["Kazekage", "Lord Kazekage"],
}

# Lower-cased surfaces that are no characters.
STOPLIST = [
    "hokage", "jutsu", "sharingan", "byakugan", "chunin", "chūnin", "genin", "jonin", "jōnin", "sensei", "ninja",
    "shinobi", "kunai", "shuriken", "ramen", "believe", "dattebayo", "hey", "oh", "huh", "kage", "anbu", "rasengan",
    "chidori", "chakra", "village", "leaf", "sand", "sound", "mist", "father", "mother", "brother", "sister",
    "granny", "old man", "kid", "you", "me", "him", "her", "god", "lord", "lady", "bushy brows", "bushy brow",
    "fuzzy brows", "uchiha", "hyuga", "hyūga", "uzumaki", "nara", "akimichi", "yamanaka", "inuzuka", "aburame",
    "sarutobi", "sannin", "kekkei genkai", "dojo", "ichiraku", "kujaku", "jinchuriki", "jinchūriki", "humph", "hmph",
    "hmm", "ugh", "whoa", "yikes", "geez", "jeez", "darn", "dammit", "ow", "ouch",
]

# Parts of names that are stripped, and the shape of a name.
HONORIFIC = r"(?i)[-\s]?(kun|chan|sama|san|sensei|senpai|sempai|dono|nee|neesan|niisan|nii|baa-chan)$"
TITLE = r"(?i)^(lord|lady|master|sensei|miss|mister|mr\.?|ms\.?|big brother|brother)\s+"
POSSESSIVE = r"('s|')$"
NAME_SHAPE = r"^[A-Z][a-zA-Zōūāēī'-]+( [A-Z][a-zA-Zōūāēī'-]+){0,2}$"
MAX_ZIPF = 3.0

# Labels of articles, first match wins; sections that are no prose.
LABEL_PRIORITY = ["Genjutsu", "Ninjutsu", "Taijutsu"]
STOP_SECTIONS = ["trivia", "references", "see also", "notes", "in other media", "gallery"]

# Colours of the first communities by size, and of all others.
COMMUNITY_COLOURS = ["#3987e5", "#d95926", "#199e70", "#c98500", "#d55181", "#008300", "#9085e9", "#e66767"]
OTHER_COLOUR = "#8a8984"


def alias_rows() -> list[tuple[str, str]]:
    """(alias, canonical), in the order of the cast."""
    return [(alias, name) for name, aliases in CAST.items() for alias in aliases]
