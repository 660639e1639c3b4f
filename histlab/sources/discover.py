"""Which browsers and profiles there are, and scans over all of them."""

from __future__ import annotations

import sys
from dataclasses import astuple, dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import merge_by_url
from ..schema import conform
from .sqlite_source import read_chromium, read_firefox

#: Where browsers keep their profiles, below the home folder.
FOLDERS = {
    "linux": {
        "brave": ".config/BraveSoftware/Brave-Browser", "chrome": ".config/google-chrome", "chromium": ".config/chromium", "edge": ".config/microsoft-edge",
        "opera": ".config/opera", "vivaldi": ".config/vivaldi", "firefox": ".mozilla/firefox",
    },
    "darwin": {
        "brave": "Library/Application Support/BraveSoftware/Brave-Browser", "chrome": "Library/Application Support/Google/Chrome",
        "chromium": "Library/Application Support/Chromium", "edge": "Library/Application Support/Microsoft Edge",
        "opera": "Library/Application Support/com.operasoftware.Opera", "vivaldi": "Library/Application Support/Vivaldi",
        "firefox": "Library/Application Support/Firefox/Profiles",
    },
    "win32": {
        "brave": "AppData/Local/BraveSoftware/Brave-Browser/User Data", "chrome": "AppData/Local/Google/Chrome/User Data",
        "chromium": "AppData/Local/Chromium/User Data", "edge": "AppData/Local/Microsoft/Edge/User Data", "opera": "AppData/Roaming/Opera Software/Opera Stable",
        "vivaldi": "AppData/Local/Vivaldi/User Data", "firefox": "AppData/Roaming/Mozilla/Firefox/Profiles",
    },
}
NAMES = {"brave": "Brave", "chrome": "Google Chrome", "chromium": "Chromium", "edge": "Microsoft Edge", "opera": "Opera", "vivaldi": "Vivaldi", "firefox": "Firefox"}
MAX_PROFILES = 20


@dataclass(frozen=True)
class Profile:
    browser: str
    profile: str
    path: str
    flavor: str


def chromium_profiles(browser: str, base: Path) -> list[Profile]:
    """Default, Profile 1 to 20, or the folder itself where it holds a database."""
    names = ["Default", *(f"Profile {i}" for i in range(1, MAX_PROFILES + 1))]
    found = [Profile(browser, n, str(base / n / "History"), "chromium") for n in names if (base / n / "History").is_file()]
    if not found and (base / "History").is_file():
        found.append(Profile(browser, "Default", str(base / "History"), "chromium"))
    return found


def firefox_profiles(base: Path) -> list[Profile]:
    """Each folder with a places database; its name is what follows the first dot."""
    found = sorted(p for p in base.iterdir() if (p / "places.sqlite").is_file()) if base.is_dir() else []
    return [Profile("firefox", p.name.split(".", 1)[-1], str(p / "places.sqlite"), "firefox") for p in found]


def scan(home: str | Path | None = None, platform: str = sys.platform) -> list[Profile]:
    home = Path(home) if home else Path.home()
    out: list[Profile] = []
    for browser, folder in FOLDERS.get(platform, FOLDERS["linux"]).items():
        base = home / folder
        out += firefox_profiles(base) if browser == "firefox" else chromium_profiles(browser, base)
    return out


def browser_type(name: str) -> str | None:
    """The browser that a name given by a user means."""
    low = name.strip().lower()
    return next((k for k, v in NAMES.items() if low in (k, v.lower())), None)


def sources_table(spark: SparkSession, profiles: list[Profile]) -> DataFrame:
    return spark.createDataFrame([astuple(p) for p in profiles], "browser string, profile string, path string, flavor string")


def read_profiles(spark: SparkSession, profiles: list[Profile], cutoffs: dict[str, int] | None = None) -> DataFrame:
    """The bag union of all profiles' histories; ``cutoffs`` are raw times by flavour, inclusive."""
    cutoffs = cutoffs or {}
    parts = []
    for p in profiles:
        rows = read_firefox(spark, [p.path], cutoffs.get("firefox")) if p.flavor == "firefox" else read_chromium(spark, [p.path], cutoffs.get("chromium"), True)
        parts.append(rows.withColumns({"browser": F.lit(p.browser), "profile": F.lit(p.profile)}))
    return reduce(DataFrame.unionByName, parts) if parts else conform(spark.createDataFrame([], "url string"))


def read_all_browsers(spark: SparkSession, home: str | Path | None = None, cutoffs: dict[str, int] | None = None, platform: str = sys.platform) -> DataFrame:
    """All browsers' histories merged by URL."""
    return conform(merge_by_url(read_profiles(spark, scan(home, platform), cutoffs)))
