"""Quality scores of summary texts as pure column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords by business domain, phrases of business value, technical terms.
DOMAINS = {
    "sales": "revenue,sales,customer,order,transaction,purchase,billing,invoice,payment,conversion,lead,opportunity,pipeline,forecast,quota,commission,pricing,product",
    "finance": "financial,accounting,budget,cost,expense,profit,margin,cash,flow,balance,ledger,journal,audit,tax,compliance,reporting,statement,analysis",
    "hr": "employee,staff,workforce,personnel,payroll,benefits,performance,evaluation,training,recruitment,hire,department,organization,management,role,position",
    "operations": "process,workflow,operation,efficiency,productivity,quality,performance,monitoring,optimization,automation,scheduling,resource,capacity,throughput,delivery",
    "warehouse": "data,warehouse,dimensional,fact,dimension,staging,etl,extract,transform,load,integration,consolidation,reporting,analytics,business intelligence,dashboard",
    "analytics": "analysis,analytics,insights,trends,patterns,metrics,kpi,dashboard,reporting,visualization,intelligence,forecasting,prediction,modeling,statistics,data mining",
}
VALUE = "business,enables,supports,critical,important,decision,analysis,reporting,tracking,monitoring,optimization,efficiency,performance,value,insights"
JARGON = "dll,api,sql,jdbc,odbc,xml,json,csv,etl,ssis,dtsx,oledb,ado,connection,dataset,recordset,stored procedure,function,trigger,index,primary key,foreign key,constraint,schema,metadata,configuration"
# Fixed values by validation level: words and characters from/to, weights, flag thresholds.
RANGES = {"production": (15, 100, 75, 500), "staging": (10, 120, 50, 600), "development": (5, 150, 25, 750)}
WEIGHTS = {"production": (0.15, 0.25, 0.20, 0.20, 0.20), "staging": (0.15, 0.20, 0.15, 0.25, 0.25), "development": (0.20, 0.15, 0.10, 0.25, 0.30)}
FLAGS = {"production": (0.8, 0.6, 0.4), "staging": (0.7, 0.5, 0.3), "development": (0.6, 0.4, 0.2)}


def words(text: Column) -> Column:
    """Words between white space, none empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def held(text: Column, terms: str) -> Column:
    """How many of the comma-separated terms the lower-cased text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.when(low.contains(t), 1).otherwise(0) for t in terms.split(",")])


def length_score(text: Column, level: str = "development") -> Column:
    w0, w1, c0, c1 = RANGES[level]
    w, c = F.size(words(text)), F.length(F.coalesce(text, F.lit("")))
    short = F.least(w / w0, c / c0)
    return F.when((w >= w0) & (w <= w1) & (c >= c0) & (c <= c1), 1.0).when((w < w0) | (c < c0), short).otherwise(F.least(F.lit(w1) / w, F.lit(c1) / c))


def business_score(text: Column) -> Column:
    best = F.greatest(*[held(text, k) / len(k.split(",")) for k in DOMAINS.values()])
    return best * 0.7 + held(text, VALUE) / len(VALUE.split(",")) * 0.3


def jargon_penalty(text: Column) -> Column:
    n = F.size(words(text))
    ratio = F.when(n > 0, held(text, JARGON) / n).otherwise(0.0)
    return F.when(ratio < 0.1, 0.0).when(ratio < 0.2, 0.3).otherwise(F.least(F.lit(1.0), ratio * 2))


def readability(text: Column) -> Column:
    ws = words(text)
    n, sentences = F.size(ws), F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^.!?]", ""))
    mean = n / sentences
    long = F.size(F.filter(ws, lambda w: F.length(w) > 6)) / n
    sentence = F.when(mean <= 20, 1.0).otherwise(F.lit(20) / mean)
    word = F.when(long <= 0.3, 1.0).otherwise(F.greatest(F.lit(0.0), (0.3 - long) / 0.3 + 1.0))
    return F.when((n == 0) | (sentences == 0), 0.0).otherwise((sentence + word) / 2)


def any_of(text: Column, terms: str) -> Column:
    return held(text, terms) > 0


def completeness(text: Column, sources: Column, destinations: Column, transformed: Column) -> Column:
    """Share of four aspects that the text covers; the other columns tell what the operation has."""
    parts = [sources & any_of(text, "source,from"), destinations & any_of(text, "destination,to"), transformed & any_of(text, "transform,convert,process,change"), any_of(text, "purpose,business,enables,supports")]
    return reduce(lambda a, b: a + b, [F.when(p, 1).otherwise(0) for p in parts]) / 4


def richness(sources: Column, destinations: Column, transformed: Column, parent: Column) -> Column:
    return (F.when(sources, 1.0).otherwise(0.0) + F.when(destinations, 1.0).otherwise(0.0) + F.when(transformed, 1.0).otherwise(0.5) + F.when(parent, 1.0).otherwise(0.3)) / 4


def source_confidence(name: Column, details: Column, connections: Column) -> Column:
    return (F.when(name, 1.0).otherwise(0.0) + F.when(details, 1.0).otherwise(0.5) + F.least(F.lit(1.0), connections / 2)) / 3


def confidence(length: Column, business: Column, jargon: Column, readable: Column, complete: Column, rich: Column, source: Column, level: str = "development") -> Column:
    a, b, c, d, e = WEIGHTS[level]
    score = (length * a + business * b + (1.0 - jargon) * c + readable * d + complete * e) * (0.8 + rich * 0.2) * (0.9 + source * 0.1)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def flag(score: Column, critical: Column, level: str = "development") -> Column:
    top, good, fair = FLAGS[level]
    plain = F.when(score >= top, "passed").when(score >= good, "warning").when(score >= fair, "needs_review").otherwise("failed")
    return F.when(critical & (plain == "passed"), "warning").otherwise(plain)


def requires_review(score: Column, critical: Column, level: str = "development") -> Column:
    top, good, _ = FLAGS[level]
    return critical | (score < good) | ((score < top) & F.lit(level == "production"))
