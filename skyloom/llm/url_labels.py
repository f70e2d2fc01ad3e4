"""A small labelled table of made-up urls: what kind of site a host name speaks of, 1 for sites to block.

Both kinds stand in the same addresses, so that domain endings, languages and page numbers carry no sign of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BLOCKED_SITES = """
casino casino-bonus poker bet-online betting slots jackpot lottery-win win-cash free-spins roulette
adult adult-video xxx xxx-cams sex-chat porn nude escort hot-dating camgirls
spam spam-list link-farm content-farm seo-links article-spinner backlinks doorway
ads adserver ads-network banner-ads track tracker tracking-pixel clicks click-track popup popunder affiliate-offers
pharma-pills cheap-viagra weight-loss-pills payday-loan fast-loans get-rich crypto-double miracle-cure
warez cracks keygen serials torrent-dump free-movies-hd phishing malware toolbar-download
""".split()

ALLOWED_SITES = """
news daily-herald city-times library archive university college school museum gallery science physics biology
history geography atlas weather climate garden flowers forest river mountain ocean travel-notes railway
cooking recipes bakery kitchen music orchestra theatre cinema-review painting poetry novels bookshop
health clinic hospital nursing parents children teachers students research journal institute society
football tennis cycling hiking chess photography astronomy engineering software docs manual reference wiki
law council parliament farmers market carpenter workshop tools energy water house family language dictionary
tanner hester thorne anders rentin theodore brennan entwistle shirley anton ledger ontario orlan tiona bleston
""".split()

#: The same for every site; {0} is its name, {1} a number.
ADDRESSES = [
    "https://www.{0}.com/en/{1}", "http://{0}.example.net/de/{1}.html", "https://{0}.org/fr/{1}/", "http://blog.{0}.example.org/es/{1}#top",
    "https://m.{0}.example.com/en/{1}?page=2",
]


def labelled_urls(spark: SparkSession, addresses: list[str] = ADDRESSES) -> DataFrame:
    """Columns ``url`` and ``label``: every site name in every address."""
    rows = [
        (form.format(name, 37 * i + 101 * k), label)
        for names, label in ((BLOCKED_SITES, 1), (ALLOWED_SITES, 0))
        for i, name in enumerate(names)
        for k, form in enumerate(addresses)
    ]
    return spark.createDataFrame(rows, "url string, label int")
