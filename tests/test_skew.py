"""One key holds a third of the rows: results must equal a brute-force count."""

from collections import Counter, defaultdict
from decimal import Decimal

from frames import lake, money, rows, values

from cartlake.plans import customers as people
from cartlake.plans import sales


def test_hot_keys_stay_exact(spark):
    n = 3000
    order_of = [0 if i % 3 == 0 else i % 500 for i in range(n)]
    product_of = [1 if i % 3 == 1 else i % 40 for i in range(n)]
    buyer_of = [0 if o % 3 == 0 else o % 60 for o in range(500)]
    data = lake(
        spark,
        customers=rows(spark, "customers", customer_id=list(range(60)), country=[f"C{c % 4}" for c in range(60)],
                       gender=[("Male", "Female", "Other")[c % 3] for c in range(60)]),
        products=rows(spark, "products", product_id=list(range(40)), product_name=[f"p{p % 7}" for p in range(40)],
                      category=[f"k{p % 5}" for p in range(40)]),
        orders=rows(spark, "orders", order_id=list(range(500)), customer_id=buyer_of,
                    total_amount=money(*[str(o) for o in range(500)]),
                    shipping_country=[f"C{b % 4}" for b in buyer_of]),
        order_items=rows(spark, "order_items", order_item_id=list(range(n)), order_id=order_of,
                         product_id=product_of, quantity=[i % 5 + 1 for i in range(n)],
                         unit_price=money(*["1.25"] * n)),
    )
    revenue, orders = defaultdict(Decimal), defaultdict(set)
    for i in range(n):
        revenue[product_of[i]] += Decimal("1.25") * (i % 5 + 1)
        orders[product_of[i]].add(order_of[i])
    best = sorted(revenue, key=lambda p: (-revenue[p], p))[:20]
    assert values(sales.top_products(data)) == [
        (f"p{p % 7}", f"k{p % 5}", revenue[p], len(orders[p])) for p in best]

    sold, lines, buyers = defaultdict(Decimal), Counter(), defaultdict(set)
    for i in range(n):
        buyer = buyer_of[order_of[i]]
        sold[f"C{buyer % 4}", product_of[i]] += Decimal(order_of[i])
        lines[product_of[i], buyer % 3] += 1
        buyers[product_of[i]].add(buyer)
    peak = {c: max(v for (k, _), v in sold.items() if k == c) for c in {k for k, _ in sold}}
    expected = sorted(
        (c, f"p{p % 7}", v, len(buyers[p]), 100.0 * lines[p, 0] / len(buyers[p]))
        for (c, p), v in sold.items() if v == peak[c])
    got = sorted((r.country, r.product_name, r.total_sales, r.customer_count, r.male_percent)
                 for r in sales.top_seller_per_country(data).collect())
    assert got == expected

    per_buyer = Counter(buyer_of)
    male = Counter()
    for c in range(60):
        if c % 3 == 0:
            male[f"C{c % 4}"] += max(1, per_buyer[c])
    assert {r.country: r.male_customers for r in people.customer_demographics(data).collect()} == dict(male)
