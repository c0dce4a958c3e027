select 'l' || p_partkey as licence_id, ['MIT', 'Apache 2.0', 'Apache-2.0', ' '][p_partkey % 4 + 1] as spdx_id, ['permissive', 'custom', 'weird'][(p_partkey // 2) % 3 + 1] as family, p_size % 7 as permissiveness,
 ['HIGH', 'LOW', 'MAYBE'][(p_partkey // 3) % 3 + 1] as confidence, p_partkey % 3 <> 1 as url, (p_partkey // 5) % 2 = 1 as excerpt, (p_partkey // 7) % 3 as excerpt_kind,
 (p_partkey // 11) % 3 = 0 as verified, p_partkey % 4 = 0 as corrected, (p_partkey // 8) % 2 = 0 as evidence, (p_partkey // 16) % 3 = 0 as raised from part
