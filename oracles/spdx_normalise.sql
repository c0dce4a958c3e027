select p_partkey, s.* exclude (k) from part join (values
 (0,'MIT','MIT',true,'MIT','MIT',false,true,'high'),
 (1,' MIT License ','MIT',false,null,'MIT',false,true,'high'),
 (2,'mit','MIT',true,'MIT','MIT',false,true,'high'),
 (3,'Mit','MIT',true,'MIT','MIT',false,true,'high'),
 (4,'Apache-2','Apache-2.0',false,null,'Apache-2.0',false,true,'high'),
 (5,'APACHE-2.0','Apache-2.0',true,'Apache-2.0','Apache-2.0',false,true,'high'),
 (6,'GPLv2','GPL-2.0-only',false,null,'GPL-2.0-only',false,true,'high'),
 (7,'gpl-3.0-ONLY','GPL-3.0-only',true,'GPL-3.0-only','GPL-3.0-only',false,true,'high'),
 (8,'LGPL-2.1','LGPL-2.1-only',false,null,'LGPL-2.1-only',false,true,'high'),
 (9,'New BSD','BSD-3-Clause',false,null,'BSD-3-Clause',false,true,'high'),
 (10,'FreeBSD','BSD-2-Clause',false,null,'BSD-2-Clause',false,true,'high'),
 (11,'Public Domain','CC0-1.0',false,null,'CC0-1.0',false,true,'high'),
 (12,'CC BY 4.0','CC-BY-4.0',false,null,'CC-BY-4.0',false,true,'high'),
 (13,'proprietary','UNLICENSED',false,null,'UNLICENSED',false,true,'high'),
 (14,'MPL-2.0+','MPL-2.0+',true,null,'MPL-2.0+',false,true,'high'),
 (15,'GPL-2.0+','GPL-2.0+',false,null,'',false,false,'low'),
 (16,'LicenseRef-','LicenseRef-',false,null,'',false,false,'low'),
 (17,'LicenseRef-x','LicenseRef-x',true,null,'LicenseRef-x',false,true,'high'),
 (18,'licenseref-Y','licenseref-Y',true,null,'licenseref-Y',false,true,'high'),
 (19,'MIT or ISC','MIT or ISC',false,null,'MIT or ISC',true,true,'medium'),
 (20,'MIT AND (ISC OR Zlib)','MIT AND (ISC OR Zlib)',false,null,'MIT AND (ISC OR Zlib)',true,true,'medium'),
 (21,'MIT OR Nope','MIT OR Nope',false,null,'',false,false,'low'),
 (22,' OR ','OR',false,null,'',false,false,'low'),
 (23,'WTFPL','WTFPL',true,'WTFPL','WTFPL',false,true,'high'),
 (24,'openrail++-m','OpenRAIL++-M',true,'OpenRAIL++-M','OpenRAIL++-M',false,true,'high'),
 (25,'SEE LICENSE IN LICENSE','SEE LICENSE IN LICENSE',true,'SEE LICENSE IN LICENSE','SEE LICENSE IN LICENSE',false,true,'high'),
 (26,'none','NONE',true,'NONE','NONE',false,true,'high'),
 (27,'','',false,null,'',false,false,''),
 (28,'unknown words','unknown words',false,null,'',false,false,'low'),
 (29,'BSD 2-Clause','BSD-2-Clause',false,null,'BSD-2-Clause',false,true,'high')
) s(k, raw, norm, valid, canonical, spdx, expression, resolved, confidence) on s.k = p_partkey % 30
