"""8. URL filters: host and path rules, and for URLs without a rule logistic regression on hashed character n-grams.

The model reads the n-grams (3 to 5 bytes) of host and path, hashed to 2^15 columns, and is trained by gradient descent on a small
labelled table of made-up URLs (`labelled_urls`), about a third of them to be blocked: gambling, pills, adult sites, link farms, trackers and
advertising, malware and phishing. No host of the test tables is in it. Parsing and rules are SQL expressions; the longest rule that fits
decides, the model judges the rest.

Defined cases: a null URL or one without `://` has an empty host and path, which no rule fits; the model judges it by its intercept alone,
the base rate of the table, which is below a half: it is allowed. URLs of any length are read whole. Rules of equal length can't both
fit unless they are equal; of these the first stated counts. Repeated rows stay rows. An empty table gives no row. Kept columns called host,
path, rule, verdict or block_probability raise ValueError; others make no difference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortgeo.llm.common import map_batches, utf8

#: (verdict, host, path) of the production rules; a rule fits its host and all subdomains, where the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
GRAMS, COLUMNS = (3, 4, 5), 1 << 15

#: The labelled table: URLs to be blocked, and to be allowed.
_BLOCK = """
royal-casino.example/slots casinogold.example/bonus megacasino888.example/en/ live-casino-club.example/ best-online-casinos.example/top10 jackpot-city.example/spin slotmachines.example/play
betnow.example/odds sportbets.example/live betting-tips.example/today bigbets24.example/ allbets.example/de/4 free-spins.example/claim freebonus.example/ poker-stars-room.example/table pokerwin.example/
winbig.example/now win-money-fast.example/ lottery-winner.example/prize lotto-win.example/claim cheapviagra.example/buy cheap-meds.example/order discount-pills.example/shop pillstore.example/
dietpills.example/slim buy-pills-online.example/ rx-cheap.example/cart cheap-drugs.example/ onlinepharma-cheap.example/ viagra-cialis.example/ adultfriend.example/chat adult-cams.example/live adultpics.example/ adult-zone.example/ adults-only.example/enter theadultsite.example/
adultvideo.example/tube xxx-tube.example/ xxxmovies.example/hd free-xxx.example/ pornhd.example/watch sexchat.example/ hot-sex-dates.example/ nude-cams.example/ spamlinks.example/list link-farm.example/seo
seo-farm.example/backlinks spam-mailer.example/ farmlinks.example/ cheapbacklinks.example/ spammy-offers.example/ content-farm.example/tags adserver.example/banner ads-network.example/click adclick.example/redirect
popads.example/pop ad-track.example/pixel clicktracker.example/t.gif trackpixel.example/ webtrack.example/beacon ads-delivery.example/js tracking-ads.example/id banner-ads.example/ free-iphone.example/winner
freegift.example/claim free-cash.example/ free-download-crack.example/setup.exe keygen-crack.example/ malware-host.example/payload.exe trojan-drop.example/ phish-bank.example/login secure-login-verify.example/account
account-verify.example/update paypa1-login.example/signin wallet-seed.example/recover crypto-doubler.example/ quick-loans-now.example/ payday-loan.example/apply get-rich.example/
""".split()
_ALLOW = """
news.example/world dailynews.example/2023/05/ citypaper.example/local morningpost.example/politics radio.example/live weather.example/forecast weathermap.example/de/12 science.example/physics
sciencelab.example/papers/7 university.example/courses college.example/admissions school.example/calendar library.example/catalogue citylibrary.example/opening archive.example/1998/ museum.example/exhibitions
artmuseum.example/en/ history.example/rome encyclopedia.example/wiki/Tree wiki.example/River dictionary.example/word docs.example/manual developer.example/api/v2 opensource.example/projects code.example/repo
forum.example/thread/12 community.example/questions blog.example/post/3 myblog.example/2020/ gardening.example/roses gardens.example/fr/44 recipes.example/soup kitchen.example/bread cooking.example/pasta
restaurant.example/menu cafe.example/ bakery.example/ hotel.example/rooms travel.example/guide trains.example/timetable airport.example/arrivals maps.example/city hiking.example/trails mountains.example/
lakes.example/fishing rivers.example/ ocean.example/whales birds.example/species animals.example/cats zoo.example/tickets health.example/heart hospital.example/wards clinic.example/doctors dentist.example/
medicine.example/research government.example/law parliament.example/debates court.example/rulings police.example/contact taxes.example/forms election.example/results council.example/meetings
bank.example/branches insurance.example/car economy.example/markets business.example/ jobs.example/engineer company.example/about shop.example/shoes books.example/novels bookshop.example/poetry
music.example/concerts orchestra.example/season theatre.example/plays cinema.example/tonight film.example/review photos.example/album painting.example/oil design.example/ football.example/league
tennis.example/scores cycling.example/tour running.example/marathon chess.example/openings games.example/board mathematics.example/proofs statistics.example/tables astronomy.example/stars chemistry.example/acids
biology.example/cells geology.example/rocks language.example/grammar translation.example/en/5 philosophy.example/ethics religion.example/ church.example/ children.example/stories toys.example/ parents.example/
house.example/plans furniture.example/ architecture.example/bridges engineering.example/ energy.example/solar water.example/supply farm.example/cows forest.example/oak climate.example/report
elandra.example/fr/77 morentu.example/ thessoral.example/en/3 quenolit.example/a/b verdanshe.example/es/9 ondrihel.example/de/81 leuvaro.example/index.html tharnisco.example/ relquient.example/x
saventhor.example/ ingerald.example/p/2 mentolure.example/ aubrescht.example/de/ nioventa.example/es/ sthereli.example/page
""".split()
_FRONT, _END = ("", "www.", "m.", "old."), ("com", "net", "org", "info")


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 if to be blocked): each URL under several fronts and top-level domains, the same for both labels."""
    table = []
    for y, urls in ((1, _BLOCK), (0, _ALLOW)):
        for i, url in enumerate(urls):
            host, _, path = url.partition("/")
            for j in range(2):
                table.append((f"{_FRONT[(i + j) % 4]}{host}.{_END[(i // 4 + 2 * j) % 4]}", f"/{path}" if j == 0 else "/", y))
    return table


def _grams(host: list[str], path: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of every n-gram of `^host$` and of the path."""
    raw = [f"^{h}${p}".encode() for h, p in zip(host, path)]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    rows, columns = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(data) < n:
                continue
            h = np.full(len(data) - n + 1, np.uint64(n))
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + data[k : len(data) - n + 1 + k]
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
            ok = owner[: len(h)] == owner[n - 1 :]
            rows.append(owner[: len(h)][ok])
            columns.append(h[ok].astype(np.int64))
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class UrlModel:
    def __init__(self, table: list[tuple[str, str, int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4):
        y = np.array([t[2] for t in table], float)
        # The intercept is the table's base rate and isn't trained: what says nothing is judged by it.
        self.weights, self.intercept = np.zeros(COLUMNS), float(np.log(y.mean() / (1 - y.mean())))
        at, column = _grams([t[0] for t in table], [t[1] for t in table])
        size = np.sqrt(np.maximum(np.bincount(at, minlength=len(y)), 1))
        squares = np.full(COLUMNS, 1e-8)
        for _ in range(rounds):
            z = np.bincount(at, self.weights[column], len(y)) / size + self.intercept
            error = 1 / (1 + np.exp(-z)) - y
            g = np.bincount(column, (error / size)[at], COLUMNS) / len(y) + decay * self.weights
            squares += g * g
            self.weights -= rate * g / np.sqrt(squares)

    def probability(self, host: list[str], path: list[str]) -> np.ndarray:
        at, column = _grams(host, path)
        size = np.sqrt(np.maximum(np.bincount(at, minlength=len(host)), 1))
        z = np.bincount(at, self.weights[column], len(host)) / size + self.intercept
        return 1 / (1 + np.exp(-z))


def parse(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. For rule lists of up to a few hundred."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


_MODEL: list[UrlModel] = []


def url_model() -> UrlModel:
    if not _MODEL:
        _MODEL.append(UrlModel(labelled_urls()))
    return _MODEL[0]


def judge(pages: DataFrame, keep: list[str], url_col: str = "url", rules=RULES) -> DataFrame:
    """`keep`, host, path, rule, verdict and the model's probability that the URL is to be blocked."""
    shared = pages.sparkSession.sparkContext.broadcast(url_model())  # 2^15 weights
    base = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(url_col).alias("__url"))
    host, path = parse(F.col("__url"))
    parsed = base.withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "__verdict": verdict}).drop("__url")

    def work(batch: pa.RecordBatch) -> dict:
        names = batch.schema.names
        p = shared.value.probability(*(batch.column(names.index(c)).to_pylist() for c in ("host", "path")))
        fixed = batch.column(names.index("__verdict")).to_pylist()
        return {"verdict": pa.array([v or ("block" if x > 0.5 else "allow") for v, x in zip(fixed, p)], pa.string()), "block_probability": p}

    return map_batches(parsed, parsed.columns, "verdict string, block_probability double", work).drop("__verdict")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id"])
