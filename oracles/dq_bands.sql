select rule_id, obligation_kind, severity from (
 select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rule_id, l_returnflag = 'A' as trap, ['ATTRIBUTION', 'SOURCE_DISCLOSURE', 'NON_COMMERCIAL', 'PATENT_GRANT', 'SOMETHING'][(l_linenumber + l_partkey) % 5 + 1] as obligation_kind,
  ['BLOCK', 'CONDITION', 'NOTE'][l_suppkey % 3 + 1] as severity from lineitem)
where not trap and not case obligation_kind when 'ATTRIBUTION' then severity = 'CONDITION' when 'SOURCE_DISCLOSURE' then severity in ('BLOCK', 'CONDITION') when 'NON_COMMERCIAL' then severity = 'BLOCK' when 'PATENT_GRANT' then severity = 'NOTE' else true end
