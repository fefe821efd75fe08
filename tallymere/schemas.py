"""Declared schemas; nothing is inferred.

Dates are ``YYYY-MM-DD`` strings where the contract says so, prices are binary
doubles, and payloads stay whole as JSON under their source's name.
"""

from __future__ import annotations

#: Source names in rank order; the order of records across sources is data.
SOURCES = ("upstox", "nse", "groww", "zerodha")
KNOWN_SOURCES = ("nse", "bse", "upstox", "groww", "zerodha", "investorgain")
#: Orders of arrival in a source lie below this, clocks in microseconds included.
RANK = 1 << 60

BAND = "struct<minimum:double,maximum:double>"
URLS = "struct<rhp:string,drhp:string>"
STD_RECORD = (
    "src string, ord bigint, isin string, symbol string, company_name string, status string, bidding_start_date string, "
    f"price_band {BAND}, document_urls {URLS}, listing_date string, raw_sources map<string,string>"
)
TIMELINE_EVENTS = ("drhp_available", "rhp_available", "open", "close", "allotment", "listing")
EVENT = "struct<status:string,date:string,source:string,detected_at:string>"

# Payloads of the feeds, as far as the engine reads them.
UPSTOX = (
    "id string, symbol string, name string, status string, isin string, issue_type string, industry string, issue_size double, "
    "minimum_price double, maximum_price double, cut_off_price double, lot_size double, face_value double, "
    "bidding_start_date string, bidding_end_date string, rhp_url string, drhp_url string, url string, detailUrl string, "
    "timeline struct<application_start_date:string,application_end_date:string,allotment_date:string,allotment_start_date:string,listing_date:string>"
)
NSE_META = "struct<isin:string,symbol:string,rhpUrl:string,drhpUrl:string>"
NSE = (
    "symbol string, companyName string, company string, status string, isin string, ipoStartDate string, ipoEndDate string, issueStartDate string, "
    "issueEndDate string, listingDate string, priceRange string, issuePrice string, securityType string, rhpUrl string, drhpUrl string, "
    f"url string, detailUrl string, metaInfo {NSE_META}, details struct<metaInfo:{NSE_META}>"
)
GROWW_DETAIL = (
    "struct<status:string,startDate:string,endDate:string,listingDate:string,allotmentDate:string,companyShortName:string,companyName:string,isin:string,symbol:string,"
    "parentSearchId:string,documentUrl:string,sector:string,registrar:string,issueType:string,lastBidPlaceTime:string,isSme:boolean,minPrice:double,maxPrice:double,"
    "faceValue:double,issuePrice:double,issueSize:double,lotSize:double,listing:struct<listingPrice:double,listedOn:array<string>>,"
    "subscriptionRates:array<struct<category:string,subscriptionRate:double>>>"
)
GROWW_LIST = "struct<symbol:string,isin:string,companyName:string,searchId:string,bidStartTimestamp:bigint,categories:array<struct<minPrice:double,maxPrice:double>>>"
GROWW = f"list {GROWW_LIST}, detail {GROWW_DETAIL}, bucket string, searchId string, documentUrl string, docType string, url string, detailUrl string"
ZERODHA = (
    "symbol string, type string, isSme boolean, companyName string, detailPath string, detailUrl string, url string, biddingRange string, "
    "listingDateText string, listingDate string, priceText string, prospectusUrl string, docType string"
)
PAYLOADS = {"upstox": UPSTOX, "nse": NSE, "groww": GROWW, "zerodha": ZERODHA}
#: Texts of any length are read; by default a payload with one beyond 20,000,000 characters would be null as a whole.
PARSE = {"maxStringLen": str(2**31 - 1)}
CANDLE = "struct<date:string,open:double,high:double,low:double,close:double,volume:bigint,oi:bigint>"
