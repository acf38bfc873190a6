"""Row types of the records that flow through the engine."""

from __future__ import annotations

from functools import cache

from pyspark.sql import types as T


def notice() -> T.StructType:
    return parsed(NOTICE)


def release() -> T.StructType:
    return parsed(RELEASE)


def registry() -> T.StructType:
    return parsed(REGISTRY)


@cache
def parsed(ddl: str) -> T.StructType:
    """The type a DDL string stands for; a session must be active."""
    return T.StructType.fromDDL(ddl)


NOTICE = (
    "source_id string, source_url string, title string, tender_number string, buyer_name string, description string, province string,"
    " categories array<string>, published_at timestamp, closing_at timestamp, briefing_at timestamp, compulsory_briefing boolean,"
    " documents array<struct<url:string,filename:string>>, raw string, derived_fields map<string,string>"
)
PROVENANCE = "struct<source:string,source_id:string,confidence:double,note:string>"
RELEASE = (
    "ocid string, id string, date string, tag array<string>, initiationType string, language string, buyer struct<id:string,name:string>,"
    " tender struct<id:string,title:string,description:string,status:string,category:string,province:string,deliveryLocation:string,"
    "mainProcurementCategory:string,additionalProcurementCategories:array<string>,value:struct<amount:decimal(18,2),currency:string>,"
    "tenderPeriod:struct<startDate:string,endDate:string>,procuringEntity:struct<id:string,name:string>,"
    "briefingSession:struct<isSession:boolean,compulsory:boolean,date:string,venue:string>,"
    "documents:array<struct<id:string,title:string,url:string,format:string>>>"
)
REGISTRY = (
    "ref string, name string, type string, province string, website string, tender_url string, platform string, crawl_method string,"
    " adapter string, triage_tier int, authority_score int, frequency_min int, status string, note string"
)
