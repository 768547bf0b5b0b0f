"""Constant product-group dimension (S7): a small table used for
membership (left-semi) joins against cleaned item names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# The three product groups of the reference's constants, in
# their original order (big single products, Weilong, Lay's).
# ---------------------------------------------------------------------------
BIG_PRODUCT = [
    "卫龙魔芋爽香辣味乐享装", "卫龙魔芋爽酸辣味乐享装", "卫龙风吃海带香辣味乐享装",
    "卫龙魔芋爽微辣麻酱味乐享装180+45克", "中宝芒果干（原味）", "吾尚AD钙奶饮品mini版100克四瓶装",
    "吾尚AD钙奶饮品220克四瓶装", "丹夫巧克力薄脆（巧克力味）88克", "丹夫黄油薄脆（黄油味）88克",
    "万市香风干肉（原味）", "万市香风干肉（香辣味）", "修文酱鸭舌", "钱家香老卤鸭爪", "乡吧哥蜜汁鸡翅",
    "Gemez小鸡干脆面（辣味）14克", "Gemez小鸡干脆面（烧烤鸡肉味）16克", "Gemez小鸡干脆面（烟熏牛肉风味）14克",
    "老李香酥蹄",
]
WEILONG = [
    "卫龙麻辣麻辣很麻很辣", "卫龙大面筋（经典香辣味）", "卫龙魔芋爽（香辣味）", "卫龙亲嘴烧（麦辣鸡汁风味）",
    "卫龙调味海带", "卫龙魔芋爽麻辣素毛肚(乐享装)", "卫龙亲嘴烧（川香麻辣风味）", "卫龙亲嘴烧（经典香辣风味）",
    "卫龙魔芋爽（酸辣味）", "卫龙魔芋爽（香辣味）定量装", "卫龙魔芋爽（酸辣味）定量装", "卫龙风吃海带香辣味乐享装",
    "卫龙魔芋爽香辣味乐享装", "卫龙魔芋爽酸辣味乐享装", "卫龙小面筋经典香辣味乐享装58克",
    "卫龙魔芋爽微辣麻酱味乐享装180+45克", "卫龙大面筋经典香辣味乐享装58克", "卫龙小面筋（经典香辣味）",
]
LESHI = [
    "乐事马铃薯片黄瓜味", "乐事马铃薯片经典原味", "乐事薯条番茄味40克", "乐事薯片原味163克", "乐事无限薯片90克（番茄）",
    "乐事无限薯片90克 （原味）", "1乐事薯片无限忠于原味", "1乐事薯片黄瓜味56克", "1乐事薯片青柠味56克",
    "1乐事薯片黄瓜味35克", "1乐事薯片（黄瓜味）40克", "1乐事薯片（青柠味）70克", "乐事鲜焙裸米饼原味80克",
    "乐事薯条蜂蜜黄油味40克", "1乐事薯片无限鲜浓番茄味", "1乐事薯片无限翡翠黄瓜味", "1乐事薯片无限嗞嗞烤肉味",
    "1乐事薯片经典原味56克", "1乐事薯片经典原味35克", "乐事-张杰主题小卡和心愿卡", "乐事真脆薯条（经典原味）40克",
    "乐事薯片无限忠于原味40克", "乐事马铃薯片粉胡椒味30克", "乐事马铃薯片自然本味30克", "乐事马铃薯片墨西哥鸡汁番茄味",
    "乐事薯片无限翡翠黄瓜味40克", "乐事薯片无限嗞嗞烤肉味40克", "乐事浓郁蒜香味马玲薯片56克", "乐事清新芥香味马玲薯片56克",
    "1乐事薯片（得克萨斯烧烤味）40克", "1乐事薯片（美国经典原味）40克", "1乐事薯片（美国经典原味）70克",
    "1乐事薯片（香辣小龙虾味）70克", "乐事薯片超值装五连包23克*5包", "乐事大波浪薯片铁板鱿鱼味70克",
    "乐事流沙咸蛋黄味马玲薯片56克", "乐事无限芭拿拿香蕉味薯片90克", "1乐事薯片得克萨斯烧烤味56克",
    "1乐事薯片得克萨斯烧烤味35克", "1乐事薄切红薯片自然原味60克", "乐事薯片无限组合（忠于原味90克*2）",
    "1乐事薯片墨西哥鸡汁番茄味56克", "1乐事薯片意大利香浓红烩味56克", "1乐事薯片墨西哥鸡汁番茄味35克",
    "1乐事原切香芋片沁爽青柠味60克", "1乐事薯片（墨西哥鸡汁番茄味）40克", "1乐事薯片（意大利香浓红绘味）40克",
    "1乐事薯片（墨西哥鸡汁番茄味）70克", "乐事薯片无限组合（翡翠黄瓜味90克*2）", "1乐事大波浪薯片（美国经典原味）70克",
    "1乐事大波浪薯片（香脆烤鸡翅味）70克", "1乐事大波浪薯片（碳烤五花肉味）70克",
    "乐事薯片无限组合（忠于原味90克+翡翠黄瓜味90克）", "乐事薯片无限组合（原味90克*2+黄瓜90克*2+番茄90克）",
]
PRODUCT_GROUPS = {"big_product": BIG_PRODUCT, "weilong": WEILONG, "leshi": LESHI}


def product_groups(spark: SparkSession, clean: bool = True) -> DataFrame:
    """``(product_group, product_name)``; names cleaned with the same value
    rule as the data (``+``, ``*`` are removed on both sides of a join)."""
    from pyspark.sql import functions as F

    from ..functions.text import clean_value
    rows = [(g, n) for g, names in PRODUCT_GROUPS.items() for n in names]
    df = spark.createDataFrame(rows, "product_group string, product_name string")
    return df.withColumn("product_name", clean_value(F.col("product_name"))) if clean else df
