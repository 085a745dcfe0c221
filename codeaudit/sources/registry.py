"""Registry answers, one JSON shape per ecosystem, as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PYPI = ("info struct<version:string>, "
        "releases map<string,array<struct<upload_time_iso_8601:string>>>")
NPM = "`dist-tags` struct<latest:string>, time map<string,string>"
RUBYGEMS = "version string, downloads bigint"
CRATES = "crate struct<newest_version:string,updated_at:string,recent_downloads:bigint>"


def registry(raw: DataFrame) -> DataFrame:
    """(ecosystem, package, http_status, latest_version, latest_release_date, downloads).

    ``raw(ecosystem, package, http_status, body)``; a body that is no JSON leaves nulls, a package
    without a row was never asked for and stays unknown.
    """
    eco, body = F.col("ecosystem"), F.col("body")
    pypi, npm = F.from_json(body, PYPI), F.from_json(body, NPM)
    gems, crates = F.from_json(body, RUBYGEMS), F.from_json(body, CRATES)
    version = pypi["info"]["version"]
    uploads = F.transform(F.try_element_at(pypi["releases"], version),
                          lambda f: f["upload_time_iso_8601"])
    latest = npm["dist-tags"]["latest"]
    release = F.when(latest.isNotNull(), F.try_element_at(npm["time"], latest)).otherwise(
        F.try_element_at(npm["time"], F.lit("modified")))
    return raw.select(
        "ecosystem", "package", F.col("http_status").cast("int").alias("http_status"),
        F.when(eco == "pypi", version).when(eco == "npm", latest)
         .when(eco == "rubygems", gems["version"])
         .when(eco == "crates", crates["crate"]["newest_version"]).alias("latest_version"),
        F.when(eco == "pypi", F.array_max(uploads)).when(eco == "npm", release)
         .when(eco == "crates", crates["crate"]["updated_at"]).alias("latest_release_date"),
        F.when(eco == "rubygems", gems["downloads"])
         .when(eco == "crates", crates["crate"]["recent_downloads"]).alias("downloads"))
