"""Fixed values of the report formats: row shapes, title words, season names and skipped lines."""

from __future__ import annotations

from meadowlark.functions.text import WS

_N = r"[\d,]+"
_S = WS + "+"


def _row(*fields: str) -> str:
    return "^" + _S.join(fields) + f"{WS}*$"


#: unit, bulls, cows, calves, harvest, hunters, percent success, recreation days
HARVEST_ROW = _row(r"\d+", _N, _N, _N, _N, _N, r"\d+", _N)
HARVEST_TOTAL = _row("Total", _N, _N, _N, _N, _N, r"\d+", _N)
#: unit, antlered harvest, hunters, percent, antlerless harvest, hunters, percent
SUCCESS_ROW = _row(r"\d+", _N, _N, r"\d+", _N, _N, r"\d+")
SUCCESS_TOTAL = _row("Total", _N, _N, r"\d+", _N, _N, r"\d+")
#: herd unit, four hunter figures, four harvest figures, percent, four recreation-day figures, two rates
UNIT_ROW = _row(r"E-\d+", *[_N] * 8, r"[\d.]+%?", *[_N] * 4, r"[\d.]+", r"[\d.]+")

#: Row labels of the table by season, with their method and season.
BY_SEASON = {
    "Archery": ("archery", "all"),
    "Muzzleloader": ("muzzleloader", "all"),
    "1st Rifle": ("rifle", "1st"),
    "2nd Rifle": ("rifle", "2nd"),
    "3rd Rifle": ("rifle", "3rd"),
    "4th Rifle": ("rifle", "4th"),
    "Late Rifle": ("rifle", "late"),
}
BY_SEASON_UNIT = 851
SEASON_ROW = "^(" + "|".join(BY_SEASON) + ")" + _S + _S.join([_N] * 5 + [r"\d+", _N]) + f"{WS}*$"

TITLE_WORDS = ("Recreation Days", "Percent Success", "Confidence")

#: Column headings and notes inside sections: line starts, whole lines.
HEADING_STARTS = (
    "Total Total Percent Total", "Unit Bulls Cows Calves", "Antlered Antlered", "Unit Harvest Hunters", "Total Hunters", "Percent",
    "DAU estimate", "Total Days", "Total Recreation", "Season", "Total Total", "Unit Bulls", "Unit Harvest", "*",
)
HEADING_LINES = ("Success", "Rate", "Intervals")

#: Literal parts of lines in population reports that hold no rows.
POPULATION_SKIPS = (
    "ELK", "POST HUNT", "Post Hunt", "Bull/Cow", "DAU*", "DAU *", "GAME MANAGEMENT", "Game Management", "* DAU", "** DAU", "*** DAU",
    "post hunt", "Colorado Parks", "Terrestrial", "UNITES", "UNITS INVOLVED",
)
STATEWIDE_TOTAL = r"(?i)^Total\s+Statewide\s+Estimate\s+([\d,]+)"

#: Method and season pairs of the dashboard.
DASHBOARD_PAIRS = (
    ("all", "all"), ("archery", "all"), ("muzzleloader", "all"), ("rifle", "all"), ("rifle", "1st"), ("rifle", "2nd"), ("rifle", "3rd"), ("rifle", "4th"),
)
