"""Column layouts of the known text sources."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split(":") for f in text.split())])


# The TPC-H lineitem layout.
LINEITEM = _schema("""
    l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:int
    l_quantity:double l_extendedprice:double l_discount:double l_tax:double
    l_returnflag:string l_linestatus:string
    l_shipdate:date l_commitdate:date l_receiptdate:date
    l_shipinstruct:string l_shipmode:string l_comment:string
""")

# The 51 columns of the enriched yellow-taxi trips.
YELLOW_TAXI = _schema("""
    trip_id:long vendor_id:string pickup_datetime:string dropoff_datetime:string
    store_and_fwd_flag:int rate_code:int
    pickup_longitude:double pickup_latitude:double dropoff_longitude:double dropoff_latitude:double
    payment_type:int
    fare_amount:double surcharge:double mta_tax:double tip_amount:double tolls_amount:double
    improvement_surcharge:double total_amount:double congestion_surcharge:double airport_fee:double
    payment_type_desc:string trip_type:int pickup_geom:string dropoff_geom:string cab_type:string
    col_25:string col_26:string col_27:string col_28:string col_29:string
    col_30:string col_31:string col_32:string col_33:string pickup_borough:string
    col_35:string col_36:string col_37:string col_38:string pickup_zone:string
    col_40:string col_41:string col_42:string col_43:string dropoff_borough:string
    col_45:string col_46:string col_47:string col_48:string dropoff_zone:string
    col_50:string
""")

# The 19 columns to which monthly trip files of any vintage are brought.
YELLOW_TRIPS = _schema("""
    vendorid:long tpep_pickup_datetime:timestamp tpep_dropoff_datetime:timestamp
    passenger_count:double trip_distance:double ratecodeid:double store_and_fwd_flag:string
    pulocationid:long dolocationid:long payment_type:long
    fare_amount:double extra:double mta_tax:double tip_amount:double tolls_amount:double
    improvement_surcharge:double total_amount:double congestion_surcharge:double airport_fee:double
""")
